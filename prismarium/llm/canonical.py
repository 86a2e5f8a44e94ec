"""Problem 5: values typed by people, mapped to the entry of a reference list that they mean.

A multi-pattern automaton holds the canonical names and their aliases as token strings, of makers too. The longest
non-overlapping mentions in a value win; a mention decides if nothing stands beside it that may name another
product: only its own maker, neutral words and remarks. Values without such a mention go to token-set similarity: an
inverted index gives the entries with the same numbers or with letter pairs in common, whose words are matched
with the typed ones in any order, a word holding few typing errors.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The reference list is broadcast in parts of so many entries; a value's best match over all parts counts.
PART_ENTRIES = 200_000
#: Words that say nothing about which product is meant, by field.
NEUTRAL = {
    "make": {"the", "company", "co", "ltd", "inc", "corp", "corporation", "ag", "gmbh", "kg", "sa", "plc", "llc", "optical", "optics", "imaging", "camera", "cameras", "digital", "industries", "group", "and"},
    "model": {"camera", "digital", "body", "the", "kit", "only"},
    "lens": {"lens", "the", "with", "objective"},
}
#: Words of remarks, which may stand beside any mention.
REMARKS = {"a", "an", "my", "our", "his", "her", "old", "new", "used", "second", "hand", "bought", "borrowed", "original", "genuine", "with", "from", "by", "for", "and", "or", "of", "on", "in", "at", "is", "was", "this", "that", "very", "nice", "good", "great"}
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
_DASHES = dict.fromkeys(map(ord, "‐‑‒–—―−"), "-")


def clean(value: str) -> str:
    """Composed, lower case, one kind of dash, no control characters or trade marks, single spaces."""
    text = unicodedata.normalize("NFKC", value.replace("®", " ").replace("™", " ").replace("©", " ")).translate(_DASHES).casefold()
    return " ".join("".join(" " if unicodedata.category(c)[0] in "CZ" else c for c in text).split())


def tokens(text: str) -> list[str]:
    """Words and numbers of a cleaned text; 'Mk2', 'MARKII' and 'mark ii' become 'mark', '2'."""
    text = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", ""), text)
    text = re.sub(r"(?<![a-z])(?:mark|mk)[\s._-]*(viii|vii|vi|iv|ix|iii|ii|i|v|x|\d+)(?![a-z0-9])", lambda m: f" mark {ROMAN.get(m[1], m[1])} ", text)
    return re.findall(r"[^\W\d_]+|\d+", text.replace("&", " and "))


_NUM = r"\d+(?:[.,]\d+)?"
_SPAN = rf"{_NUM}(?:\s*-\s*{_NUM})?"


def _number(text: str) -> str:
    return "-".join(f"{float(x.replace(',', '.')):g}" for x in re.split(r"\s*-\s*", text))


def lens_tokens(text: str) -> list[str]:
    """Tokens of a lens name: words, and one token each for focal length ('150-600mm') and aperture ('f2.8')."""
    focal = aperture = None

    def first(m: re.Match) -> float:
        return float(re.split(r"\s*-\s*", m)[0].replace(",", "."))

    def put(f: str, a: str) -> str:
        nonlocal focal, aperture
        focal, aperture = _number(f) + "mm", "f" + _number(a)
        return " "

    def slash(m: re.Match) -> str:
        a, b = m[1], m[2]
        return put(b, a) if first(a) < 10 and first(a) < first(b) else put(a, b)

    text = re.sub(rf"(?<![\d.,])({_SPAN})\s*/\s*({_SPAN})\s*(?:mm)?(?![\d])", slash, text, count=1)
    if focal is None:

        def ap(m: re.Match) -> str:
            nonlocal aperture
            aperture = "f" + _number(m[1])
            return " "

        def fo(m: re.Match) -> str:
            nonlocal focal
            focal = _number(m[1]) + "mm"
            return " "

        text = re.sub(rf"(?:f\s*/\s*|(?<![\d.,])1\s*:\s*|f\s*(?=\d))({_SPAN})(?!\s*mm)(?![\d])", ap, text, count=1)
        text = re.sub(rf"(?<![\d.,])({_SPAN})\s*mm", fo, text, count=1)
    return [*tokens(text), *[x for x in (focal, aperture) if x]]


def split(field: str, value: str) -> list[str]:
    text = clean(value)
    return lens_tokens(text) if field == "lens" else tokens(text)


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent letters may be swapped), or most + 1 when beyond."""
    if a == b:
        return 0
    if most < 1 or abs(len(a) - len(b)) > most:
        return most + 1
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(word: str) -> int:
    """Typing errors that a word of this length may hold."""
    return 0 if len(word) < 3 else 1 if len(word) < 8 else 2


def short_form(code: str, name: str) -> bool:
    """Three letters, in order, of a name that begins with the first of them; or the initials of its words."""
    words = [w for w in re.findall(r"[a-z]+", name)]
    if len(words) > 1 and code in ("".join(w[0] for w in words), "".join(w[0] for w in words if w != "and")):
        return True
    rest = iter("".join(words))
    return len(code) == 3 and words and code[0] == words[0][0] and all(c in rest for c in code)


def letter_pairs(word: str) -> set[str]:
    padded = f"\x01{word}\x02"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def set_distance(typed: list[str], words: list[str], most: int) -> int:
    """Edits between two sets of words in any order: equal words go together, then those with the fewest edits; most + 1 when beyond or words are left over."""
    if len(typed) != len(words):
        return most + 1
    mine, theirs = list(typed), list(words)
    for w in typed:
        if w in theirs:
            theirs.remove(w)
            mine.remove(w)
    total = 0
    for w in mine:
        d, best = min((distance(w, x, min(most, allowed(x))), x) for x in theirs)
        total += d
        if d > allowed(best) or total > most:
            return most + 1
        theirs.remove(best)
    return total


class PairIndex:
    """Inverted index from letter pairs to words. An edit spoils at most three pairs, so a word within its allowed errors shares some."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = defaultdict(list)

    def add(self, word: str, item) -> None:
        for pair in letter_pairs(word):
            self.rows[pair].append((word, item))

    def near(self, word: str) -> list[tuple[int, object]]:
        """(edits, item) of the words within their allowed errors."""
        shared = Counter(x for pair in letter_pairs(word) for x in self.rows.get(pair, ()))
        out = []
        for (other, item), n in shared.items():
            most = allowed(other)
            if abs(len(other) - len(word)) <= most and n >= len(letter_pairs(other)) - 3 * most:
                d = distance(word, other, most)
                if d <= most:
                    out.append((d, item))
        return out


class Mentions:
    """Automaton over token strings; forms are lists of tokens."""

    def __init__(self, forms: dict[tuple[str, ...], list]):
        self.forms = {" ".join(f): items for f, items in forms.items() if f}
        self.automaton = ahocorasick.Automaton()
        for form in self.forms:
            self.automaton.add_word(f" {form} ", form)
        if self.forms:
            self.automaton.make_automaton()

    def find(self, words: list[str]) -> list[tuple[int, int, str]]:
        """Longest non-overlapping mentions: (first word, word behind the last, form)."""
        if not self.forms or not words:
            return []
        text = f" {' '.join(words)} "
        hits = [(end - len(form) - 1, end, form) for end, form in self.automaton.iter(text)]
        out: list[tuple[int, int, str]] = []
        for start, end, form in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            if all(end <= a or start >= b for a, b, _ in out):
                out.append((start, end, form))
        return [(text[: start + 1].count(" ") - 1, text[:end].count(" "), form) for start, end, form in out]


def remarks_off(field: str, text: str) -> str:
    """A cleaned value without remarks behind a comma, semicolon or bracket; what holds a number or a mark of a generation is no remark."""
    head, *rest = re.split(r"[;(\[|]|,(?!\s*\d)", text)
    return head if head.strip() and not any(re.search(r"\d|\b(?:mark|mk)\b", x) for x in rest) else text


class Matcher:
    """Maps values of the fields of a reference list of (ref_id, kind, make, name)."""

    def __init__(self, entries: list[tuple[int, str, str, str]], mentions: bool = True):
        self.exact: dict[str, set[str]] = defaultdict(set)
        self.names: dict[str, dict[int, tuple[str, ...]]] = defaultdict(dict)
        self.make_of: dict[int, str] = {}
        self.makes: dict[str, tuple[str, ...]] = {}
        #: Of each lens the words before its numbers, without the maker, and the words behind them.
        self.lens_words: dict[int, tuple[list[str], list[str]]] = {}
        forms: dict[str, dict[tuple[str, ...], list]] = {k: defaultdict(list) for k in ("make", "model", "lens", "maker")}
        self.by_numbers: dict[tuple, list[int]] = defaultdict(list)
        self.make_index, self.maker_index = PairIndex(), PairIndex()
        for ref, kind, make, name in entries:
            if ref is None or not kind or not name:
                continue
            self.exact[kind].add(name)
            words = tuple(split(kind, name))
            self.make_of[ref] = clean(make or "")
            if make and clean(make) not in self.makes:
                own = self.makes[clean(make)] = tuple(tokens(clean(make)))
                for form in self._forms(own):
                    forms["maker"][form].append(clean(make))
                    self.maker_index.add("".join(form), clean(make))
            own = self.makes.get(self.make_of[ref], ())
            if kind == "lens":
                head = tokens(re.split(r"\d", clean(name))[0])
                series = head[len(own) :] if tuple(head[: len(own)]) == own else head
                words = words[len(own) :] if words[: len(own)] == own else words
                letters = [w for w in words if not re.search(r"\d", w)]
                self.lens_words[ref] = (series, letters[len(series) :])
                self.by_numbers["lens", tuple(sorted(w for w in words if re.search(r"\d", w)))].append(ref)
            elif kind == "model":
                self.by_numbers["model", tuple(sorted(w for w in words if w.isdigit()))].append(ref)
            elif kind == "make":
                self.make_index.add("".join(p for p in words if p not in NEUTRAL["make"]), ref)
            self.names[kind][ref] = words
            if kind in forms:
                for form in self._forms(words):
                    forms[kind][form].append(ref)
        self.mentions = {k: Mentions(f if mentions else {}) for k, f in forms.items()}
        self.first_letter: dict[str, list[str]] = defaultdict(list)
        for m, parts in self.makes.items():
            if parts:
                self.first_letter[parts[0][0]].append(m)

    @staticmethod
    def _forms(words: tuple[str, ...]) -> list[tuple[str, ...]]:
        """The token forms of a name: as it is and, where it joins words by 'and', without that."""
        short = tuple(w for w in words if w != "and")
        return [words] if short == words or not short else [words, short]

    @lru_cache(maxsize=200_000)
    def find(self, field: str, value: str) -> int:
        """ref_id of the entry that ``value`` means, or 0."""
        _, refs = self.ranked(field, value)
        return refs[0] if len(refs) == 1 else 0

    def ranked(self, field: str, value: str) -> tuple[int, list[int]]:
        """(rank, entries): the entries that fit the value best, and how well; the less, the better."""
        text = remarks_off(field, clean(value))
        words = lens_tokens(text) if field == "lens" else tokens(text)
        for rank, refs in {"make": self._make, "model": self._model, "lens": self._lens}[field](words) if words else ():
            if refs:
                return rank, sorted(set(refs))
        return 1000, []

    def _mentioned(self, field: str, words: list[str], make: str | None = None) -> list[int]:
        """Entries of the mention that decides, if one does: the only one, with nothing beside it that could name another product."""
        found = self.mentions[field].find(words)
        if len(found) != 1:
            return []
        start, end, form = found[0]
        refs = self.mentions[field].forms[form]
        if field != "make":
            refs = [r for r in refs if make is None or self.make_of[r] == make]
        beside = words[:start] + words[end:]
        return refs if all(w in NEUTRAL[field] or w in REMARKS for w in beside) else []

    def _makers(self, words: list[str]) -> list[tuple[str | None, list[str]]]:
        """Makers that a value may name, each with the other words: mentioned anywhere, or by its first words mistyped, run together or in a short form; and no maker."""
        out: list[tuple[str | None, list[str]]] = []
        best: tuple[int, int, str] | None = None
        for n in range(1, min(len(words), max(map(len, self.makes.values()), default=0) + 2) + 1):
            if words[n - 1].isdigit():
                break
            for d, make in self.maker_index.near("".join(words[:n])):
                if n <= len(self.makes[make]) + 2 and (best is None or (d, -n) < best[:2]):
                    best = (d, -n, make)
        if best is None or best[0] > 1:
            for n in (1, 3):
                codes = self._coded("".join(words[:n]).replace("and", "") if n > 1 else words[0]) if len(words) >= n else ()
                if len(codes) == 1 and (best is None or best[0] > 1):
                    best = (1, -n, codes[0])
        if best is not None:
            out.append((best[2], words[-best[1] :]))
        found = self.mentions["maker"].find(words)
        if len(found) == 1 and len(set(self.mentions["maker"].forms[found[0][2]])) == 1 and (best is None or best[0] > 0):
            start, end, form = found[0]
            out.insert(0, (self.mentions["maker"].forms[form][0], words[:start] + words[end:]))
        return [*out, (None, words)]

    @lru_cache(maxsize=100_000)
    def _coded(self, code: str) -> tuple[str, ...]:
        """Makers of which ``code`` is a short form; a form begins with its maker's first letter."""
        return tuple(m for m in self.first_letter.get(code[:1], ()) if short_form(code, " ".join(self.makes[m])))

    def _make(self, words: list[str]) -> Iterator[tuple[int, list[int]]]:
        yield 0, self._mentioned("make", words)
        rest = [w for w in words if w not in NEUTRAL["make"]]
        if not rest:
            return
        near = self.make_index.near("".join(rest))
        least = min((d for d, _ in near), default=0)
        yield 1 + least, [r for d, r in near if d == least]
        coded = {m for c in {"".join(rest), "".join(words)} for m in self._coded(c)}
        yield 10, [r for r, parts in self.names["make"].items() if coded and self.make_of[r] in coded] if coded else []

    def _model(self, words: list[str]) -> Iterator[tuple[int, list[int]]]:
        options = [(make, rest) for make, rest in self._makers(words) if rest]
        for k, (make, rest) in enumerate(options):
            yield k, self._mentioned("model", rest, make)
        for k, (make, rest) in enumerate(options):
            rest = [w for w in rest if w not in NEUTRAL["model"]]
            typed = [w for w in rest if not w.isdigit()]
            digits = [w for w in rest if w.isdigit()]
            best = []
            for ref in self.by_numbers.get(("model", tuple(sorted(digits))), ()):
                if make is None or self.make_of[ref] == make:
                    parts = self.names["model"][ref]
                    own = [w for w in parts if not w.isdigit()]
                    whole = "".join(own)
                    most = 1 if len(whole.replace("mark", "", 1) if len(digits) > 1 else whole) >= 2 else 0
                    straight = [w for w in parts if w.isdigit()] == digits  # run together or cut apart, words must stand in order
                    d = min(distance("".join(typed), whole, most) if straight else most + 1, set_distance(typed, own, most))
                    if d <= most:
                        best.append((d, ref))
            if best:
                least = min(best)[0]
                yield 10 * (k + 1) + least, [r for d, r in best if d == least]

    def _lens(self, words: list[str]) -> Iterator[tuple[int, list[int]]]:
        numbers = [w for w in words if re.match(r"f?\d[\d.-]*(mm)?$", w)]
        letters = [w for w in words if w not in numbers and w not in NEUTRAL["lens"]]
        if len(numbers) != 2:
            return
        for make, rest in self._makers(letters):
            yield 0, self._mentioned("lens", rest + numbers, make)
        best = []
        for ref in self.by_numbers.get(("lens", tuple(sorted(numbers))), ()):
            score = self._lens_words(letters, ref)
            if score is not None:
                best.append((score, ref))
        if best:
            least = min(best)[0]
            yield 10 + least, [r for s, r in best if s == least]

    @lru_cache(maxsize=50_000)
    def _lens_forms(self, ref: int) -> tuple[dict[str, int], list[tuple[list[str], list[str], int]]]:
        """Ways to write a lens without its numbers: run together with what each lacks, and as words before and behind."""
        series, kinds = self.lens_words[ref]
        own = list(self.makes.get(self.make_of[ref], ()))
        makers = [(own, 0), ([w for w in own if w != "and"], 0), ([], 2), *(([c], 1) for c in self._codes(self.make_of[ref]))]
        forms = [([*m, *s], tail, cost + c2 + c3) for m, cost in makers for s, c2 in ((series, 0), ([], 2)) if m or s for tail, c3 in (((kinds, 0), ([], 3)) if kinds else (([], 0),))]
        whole: dict[str, int] = {}
        for head, tail, cost in forms:
            text = "".join(head) + "".join(tail)
            whole[text] = min(cost, whole.get(text, cost))
        return whole, forms

    def _lens_words(self, letters: list[str], ref: int) -> int | None:
        """None if the words name another lens; else how far they are from the entry's (a missing word counts little)."""
        whole, forms = self._lens_forms(ref)
        typed = "".join(letters)
        if typed in whole:
            return whole[typed]
        best = None
        for head, tail, cost in forms:
            most = allowed("".join(head))
            last = "".join(tail)
            d = distance(typed, "".join(head) + last, most)
            if d > most or not typed.endswith(last[-1:]):
                d = set_distance(letters, [*head, *tail], most)
            if d <= most:
                best = cost + 10 * d if best is None else min(best, cost + 10 * d)
        return best

    @lru_cache(maxsize=10_000)
    def _codes(self, make: str) -> tuple[str, ...]:
        """Three-letter forms of a maker that are no other maker's."""
        whole = "".join(self.makes.get(make, ()))
        if not whole:
            return ()
        out = {whole[0] + a + b for a, b in combinations(whole[1:], 2)}
        initials = "".join(w[0] for w in self.makes[make])
        out |= {initials} if len(initials) > 1 else set()
        return tuple(c for c in sorted(out) if c == initials or len(self._coded(c)) == 1)


def map_values(images: DataFrame, reference: DataFrame, fields: tuple[str, ...] = ("make", "model", "lens"), values: bool = False) -> DataFrame:
    """(image_id, field, ref_id, and the value if ``values``) for every value that is neither null, blank nor exactly a name of its kind; ref_id 0 where the list has no entry.

    ``images`` has id and the fields, other columns are ignored; ``reference`` has ref_id, kind, make and name.
    Every value is mapped where it is read, so nothing is shuffled; a worker maps a repeated value once. Ties
    between entries, and an empty reference list, give 0. A list of more than PART_ENTRIES entries is taken part by part,
    and of the parts' best matches for a value the best one counts.
    """
    wanted = reference.select("ref_id", "kind", "make", "name")
    size = wanted.count()
    if size > PART_ENTRIES:
        return _by_parts(images, wanted, size, fields, values)
    shared = images.sparkSession.sparkContext.broadcast(sorted((tuple(r) for r in wanted.collect()), key=str))  # at most PART_ENTRIES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for b in batches:
            for k, field in enumerate(fields, 1):
                known = matcher.exact[field]
                coded = b.column(k).dictionary_encode()
                refs = pa.array([None if not v.strip() or v in known else matcher.find(field, v) for v in coded.dictionary.to_pylist()], pa.int64()).take(coded.indices)
                keep = refs.is_valid()
                ids = b.column(0).filter(keep)
                typed = [b.column(k).filter(keep)] if values else []
                yield pa.RecordBatch.from_arrays([ids, pa.array([field] * len(ids), pa.string()), refs.filter(keep), *typed], ["image_id", "field", "ref_id", *["value"] * values])

    return images.select("id", *fields).mapInArrow(run, "image_id long, field string, ref_id long" + ", value string" * values)


def _by_parts(images: DataFrame, reference: DataFrame, size: int, fields: tuple[str, ...], values: bool) -> DataFrame:
    """As `map_values`: distinct values meet the list in parts; makers are kept together, and every part knows all makers of its own entries."""
    parts = -(-size // PART_ENTRIES) * 2
    typed = images.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("x.*").where("value is not null").distinct()
    sent = typed.select("field", "value", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    lists = reference.withColumn("part", F.pmod(F.xxhash64("make"), F.lit(parts)).cast("int"))

    def match(left, right):
        matcher = Matcher([tuple(r.values()) for r in right.select(["ref_id", "kind", "make", "name"]).to_pylist()])
        rows = []
        for field, value in zip(left["field"].to_pylist(), left["value"].to_pylist()):
            if value.strip():
                rank, refs = (-1, []) if value in matcher.exact[field] else matcher.ranked(field, value)
                rows.append((field, value, rank, refs))
        kinds = (("field", pa.string()), ("value", pa.string()), ("rank", pa.int64()), ("refs", pa.list_(pa.int64())))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)})

    ranked = sent.groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(match, "field string, value string, rank long, refs array<long>")
    best = ranked.groupBy("field", "value").agg(F.min(F.col("rank")).alias("rank")).join(ranked, ["field", "value", "rank"]).groupBy("field", "value", "rank").agg(F.array_distinct(F.flatten(F.collect_list("refs"))).alias("refs")).where("rank >= 0")
    found = best.select("field", "value", F.when(F.size("refs") == 1, F.col("refs")[0]).otherwise(F.lit(0)).cast("long").alias("ref_id"))
    rows = images.select(F.col("id").alias("image_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("image_id", "x.*")
    return rows.join(found, ["field", "value"]).select("image_id", "field", "ref_id", *["value"] * values)


def unmatched(images: DataFrame, reference: DataFrame) -> DataFrame:
    """(field, value, images): typed values without an entry in the list, and how many rows have them."""
    return map_values(images, reference, values=True).where("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("images"))
