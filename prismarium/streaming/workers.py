"""Workers that keep a library up to date: each polls a queue, handles what it finds, and writes a new snapshot.

Workers may run at once: each commits against the snapshot that it read, and a round that comes too late is done again.
An item that fails is left out of the round's commit, so it stays in the queue and is tried again in the next round.

A queue is an anti join, asked anew in every round, so a restarted worker goes on where the library is. With a stream
of files as source a round starts with new files; without, a trigger of rate rows gives the rhythm.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismarium.library import Library
from prismarium.operators import commands, queues
from prismarium.operators.detect import describe_images, detect_images
from prismarium.operators.files import reconcile
from prismarium.schemas import schema
from prismarium.sources.content import extract_metadata, hash_files
from prismarium.sources.scan import scan_grouped

INTERVAL = "60 seconds"


class Backoff:
    """Waits longer after each failed round: 1, 2, 4 ... seconds, at most ``most``; a good round starts over."""

    def __init__(self, most: float = 300.0, sleep: Callable[[float], None] = time.sleep):
        self.most, self.sleep, self.failures = most, sleep, 0

    def run(self, step: Callable[[], int]) -> int:
        try:
            done = step()
        except Exception:
            self.failures += 1
            self.sleep(min(self.most, 2.0 ** (self.failures - 1)))
            raise
        self.failures = 0
        return done


class Worker:
    """Runs ``step`` (giving the number of handled items) at every trigger; `stop` ends it after the current round."""

    def __init__(self, name: str, spark: SparkSession, step: Callable[[], int], backoff: Backoff | None = None):
        self.name, self.spark, self.step, self.backoff = name, spark, step, backoff or Backoff()
        self.query: StreamingQuery | None = None
        self.handled = 0

    def _round(self, _batch: DataFrame | None = None, _epoch: int = 0) -> None:
        try:
            self.handled += self.backoff.run(self.step)
        except Exception as e:  # noqa: BLE001 - what failed stays in the queue
            print(f"{self.name}: {e}")

    def run_once(self) -> int:
        before = self.handled
        self._round()
        return self.handled - before

    def start(self, checkpoint: str, interval: str = INTERVAL) -> Worker:
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        self.query = ticks.writeStream.queryName(self.name).foreachBatch(self._round).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
        return self

    def follow(self, files: str, table: str, checkpoint: str) -> StreamingQuery:
        """One round for the Parquet files that have come into ``files`` since the last time."""
        fresh = self.spark.readStream.schema(schema(table)).parquet(files)
        return fresh.writeStream.queryName(self.name).foreachBatch(self._round).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()


def describer(library: Library, model_id: str, load: Callable[[], Callable[[str], str]], now: Callable[[], int] = lambda: int(time.time())) -> Worker:
    """Describes images that lack a description by the model."""

    def step() -> int:
        now_ = library.snapshot()
        todo = queues.needing_description(now_.table("images"), now_.table("ai_descriptions"), model_id)
        said = describe_images(todo, model_id, load, now()).withColumn("seq", F.col("image_id")).cache()
        done = said.count()
        if done:
            library.commit(now_, ai_descriptions=commands.upsert_descriptions(now_.table("ai_descriptions"), said))
        said.unpersist()
        return done

    return Worker("describer", library.spark, step)


def face_finder(library: Library, load: Callable) -> Worker:
    """Finds faces in images that have no face row."""

    def step() -> int:
        now = library.snapshot()
        todo = queues.needing_faces(now.table("images"), now.table("face_detections"))
        found = detect_images(todo, load).withColumn("seq", F.col("image_id")).withColumn("person_id", F.lit(None).cast("long")).cache()
        done = found.select("image_id").distinct().count()
        if done:
            library.commit(now, face_detections=commands.insert_faces(now.table("face_detections"), found))
        found.unpersist()
        return done

    return Worker("face_finder", library.spark, step)


def metadata_filler(library: Library, queue: Callable[[DataFrame], DataFrame] = queues.needing_metadata) -> Worker:
    """Reads camera fields of images in the queue; `queues.never_extracted` is another queue."""

    def step() -> int:
        now = library.snapshot()
        todo = queue(now.table("images"))
        read = extract_metadata(todo).join(todo, "path").withColumn("seq", F.col("id")).drop("path").cache()
        done = read.count()
        if done:
            library.commit(now, images=commands.update_metadata(now.table("images"), read))
        read.unpersist()
        return done

    return Worker("metadata_filler", library.spark, step)


def scanner(library: Library, folder: str, now: Callable[[], int] = lambda: int(time.time())) -> Worker:
    """Reconciles the library with a folder; a folder that does not exist is left for later."""

    def step() -> int:
        if not os.path.isdir(folder):
            return 0
        base = library.snapshot()
        images = base.table("images")
        actions = reconcile(images.select("path", "status"), scan_grouped(library.spark, folder)).cache()
        done = actions.count()
        if done:
            marks = actions.where("action <> 'insert'").select(F.lit(1).alias("seq"), "path", F.when(F.col("action") == "mark_missing", "missing").otherwise("present").alias("status"))
            new = hash_files(actions.where("action = 'insert'")).where("hash is not null").join(actions.select("path", "raw_path"), "path")
            inserts = new.select(F.lit(1).cast("long").alias("seq"), "path", "hash", F.col("size").alias("file_size"), "raw_path")
            library.commit(base, images=commands.insert_images(commands.mark(images, marks), inserts, now()))
        actions.unpersist()
        return done

    return Worker("scanner", library.spark, step)


def sessions(log: DataFrame) -> DataFrame:
    """State of tagging sessions from their log (session, seq, action, face_id, person_id): each face's last standing decision.

    The n-th 'back' takes away the last decision before it that still stands, which is a matching of brackets: a decision
    stands if no later point of its session has as many more backs than decisions.
    """
    step = F.when(F.col("action") == "back", -1).otherwise(1)
    w = Window.partitionBy("session").orderBy("seq")
    # Backs with nothing to undo do nothing: the depth is held at 0 by subtracting its running minimum.
    depth = log.withColumn("raw", F.sum(step).over(w))
    floor = F.least(F.lit(0), F.min("raw").over(w))
    held = depth.withColumn("depth", F.col("raw") - floor)
    later = F.min("depth").over(w.rowsBetween(1, Window.unboundedFollowing))
    standing = held.withColumn("later", later).where("action <> 'back'").where(F.coalesce(F.col("later"), F.col("depth")) >= F.col("depth"))
    return commands.latest(standing.select("session", "face_id", "seq", "action", "person_id"), "session", "face_id")
