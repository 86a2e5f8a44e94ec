import itertools

import pytest

from prismarium.operators.search import COLUMNS, SearchQuery, escape_like, fts_query, library_rows, search, search_by_join, search_persons
from prismarium.schemas import conform


@pytest.fixture(scope="module")
def library(spark):
    images = spark.createDataFrame(
        [(1, "/l/sunset.jpg", 10, "present", "sunset.jpg", "Canon", None), (2, "/l/portrait_1.jpg", 20, "present", "portrait_1.jpg", None, "Ét 50%"), (3, "/l/gone.jpg", 30, "missing", "gone.jpg", "Canon", None), (4, "/l/d.jpg", 20, "present", None, None, None)],
        "id long, path string, added_at long, status string, filename string, make string, lens string",
    )
    said = spark.createDataFrame([(1, 1, "a", "red sky", 1), (2, 1, "b", "blue sea", 2), (3, 2, "a", None, 3), (4, None, "a", "red", 4)], "id long, image_id long, model_id string, description string, created_at long")
    persons = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, None)], "id long, name string")
    faces = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, None), (4, 2, 9), (5, 4, 3)], "id long, image_id long, person_id long")
    members = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 4), (4, 8, None)], "id long, collection_id long, image_id long")
    return conform(images, "images"), said, faces, persons, members


def ids(df):
    return [r.id for r in df.collect()]


def test_tokens_are_met_by_one_joined_row(library):
    ask = lambda text: ids(search(*library, SearchQuery().with_text(text)))
    assert ask("sunset") == [1]
    assert ask("alice bob") == []  # two persons in two faces
    assert ask("red blue") == []  # two descriptions
    assert ask("alice red") == [1]
    assert ask("CANON alice blue sunset") == [1]
    assert ask("gone") == []  # missing


def test_wildcards_and_accents(library):
    ask = lambda text: ids(search(*library, SearchQuery().with_text(text)))
    assert ask("50%") == [2]
    assert ask("t_1") == [2]
    assert ask("é") == []  # only A to Z lose their case in columns, so É stays
    assert ask("\\") == []


def test_newest_first_pages_and_collections(library):
    q = SearchQuery()
    assert ids(search(*library, q)) == [2, 4, 1]
    assert ids(search(*library, q.with_limit(1).with_offset(1))) == [4]
    assert ids(search(*library, q.with_limit(0))) == []
    assert ids(search(*library, q.with_offset(10))) == []
    assert ids(search(*library, q.with_collection(7))) == [4, 1]
    assert ids(search(*library, q.with_collection(99))) == []


def test_masks_equal_joins(library):
    words = ["alice", "red", "jpg", "canon", "blue", "zzz"]
    for n in (1, 2, 3):
        for tokens in itertools.combinations(words, n):
            q = SearchQuery().with_text(" ".join(tokens))
            assert ids(search(*library, q)) == ids(search_by_join(*library, q)), tokens


def test_builder_and_full_text_form():
    assert SearchQuery().with_text("   ").is_empty()
    assert SearchQuery().with_text("  nikon ").text == "nikon"
    assert fts_query('say "hello"') == '"say"* """hello"""*'
    assert escape_like("A%b_\\") == "a\\%b\\_\\\\"


def test_persons_by_wildcards(spark):
    persons = spark.createDataFrame([(1, "Anna"), (2, "a_na"), (3, None), (4, "O'Neil")], "id long, name string")
    assert ids(search_persons(persons, "a_n")) == [1, 2]
    assert ids(search_persons(persons, "")) == [1, 4, 2]
    assert ids(search_persons(persons, "o'n")) == [4]


def test_empty_tables(spark, library):
    empty = [df.limit(0) for df in library]
    assert ids(search(*empty, SearchQuery().with_text("x"))) == []
    assert library_rows(empty[0]).columns == ["id", "path", "added_at", "status", "raw_path", "meta"]
    assert len(COLUMNS) == 16
