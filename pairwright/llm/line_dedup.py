"""Line dedup over levelled sorted runs of line keys.

A run is a table (key, docs) sorted by key in the shared folder: how many documents of its batches hold a line. New
runs start at level 0; when a level has FANOUT runs they are merged into one run of the next level. A new batch is
merge-anti-joined with the keys that the runs already hold often enough, as those need no more counting, and what
remains becomes its run. Lines are never sent anywhere but as 16-byte keys. Up to BROADCAST hot keys go to every executor and
texts stay where they are; beyond that each text is joined with the hot keys among its own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import bytes_of, forget, free_name, map_arrow, require, save

FANOUT = 4
#: Batches that a single table is ingested in.
BATCHES = 4


#: Hot keys (16 bytes each) that are broadcast at most.
BROADCAST = 200_000


def line_key(line: bytes) -> bytes | None:
    """16 bytes of the stripped line with A-Z lower-cased; None for a line of white space. bytes methods know ASCII only."""
    bare = line.strip(b" \t\n\x0b\f\r").lower()
    return hashlib.blake2b(bare, digest_size=16).digest() if bare else None


def keys_of(text: bytes) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := line_key(line))}


class LineRuns:
    """The levels of runs; min_docs: from so many documents on, a key is hot and is no more counted."""

    def __init__(self, spark: SparkSession, min_docs: int):
        self.spark, self.min_docs = spark, min_docs
        self.levels: list[list[DataFrame]] = []

    def counts(self) -> DataFrame | None:
        """(key, docs) over all runs."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("key").agg(F.sum("docs").alias("docs")) if len(runs) > 1 else out

    def hot(self) -> DataFrame:
        """The keys of at least min_docs documents."""
        counts = self.counts()
        if counts is None:
            return self.spark.createDataFrame([], "key binary")
        return counts.where(F.col("docs") >= self.min_docs).select("key")

    def add(self, keys: DataFrame) -> None:
        """Ingests a batch: (key, docs), a key once. Keys that are hot already are left out, the rest make a run."""
        fresh = keys.join(self.hot(), "key", "left_anti") if self.levels else keys
        self._put(0, save(fresh.repartition("key").sortWithinPartitions("key")))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FANOUT:
            old, self.levels[level] = self.levels[level], []
            merged = old[0]
            for r in old[1:]:
                merged = merged.unionByName(r)
            self._put(level + 1, save(merged.groupBy("key").agg(F.sum("docs").alias("docs")).sortWithinPartitions("key")))
            forget(*old)


def drop_hot_lines(docs: DataFrame, min_docs: int = 10, batches: int = BATCHES, broadcast_limit: int = BROADCAST) -> DataFrame:
    """docs with the lines whose key is in at least min_docs documents taken out of text; adds n_lines and n_dropped.

    docs: text and any other columns; a row is a document, so repeated rows count each. Null and empty texts are one
    empty line and stay ''. Keys are the lines stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased; lines without a
    key always stay. No column names are reserved but n_lines and n_dropped, which are replaced. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    # a row's batch depends on its text alone, so a task that runs again gives the same rows
    address = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))

    def keys(batch):
        data, at = bytes_of(batch.column(1))
        rows, found = [], []
        for i in range(batch.num_rows):
            own = keys_of(data[at[i] : at[i + 1]].tobytes())
            rows += [i] * len(own)
            found += own
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(found, pa.binary())], ["row", "key"]) if rows else None

    lines = map_arrow(require(docs, "text").select(address.alias("row"), F.col("text").cast("binary").alias("text")), keys, "row long, key binary")
    runs = LineRuns(spark, min_docs)
    counted = save(lines.groupBy(F.pmod("row", F.lit(batches)).cast("int").alias("batch"), "key").agg(F.count("*").alias("docs")))
    for i in range(batches):
        runs.add(counted.where(F.col("batch") == i).select("key", "docs"))
    hot = save(runs.hot())
    forget(counted)
    temp = docs.drop("n_lines", "n_dropped")
    names = temp.columns
    hot_name, row_name = free_name(temp, "hot"), free_name(temp, "row")
    if hot.count() <= broadcast_limit:
        everywhere = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in hot.collect()))
    else:
        everywhere = None
        own = lines.join(hot, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias(hot_name)).withColumnRenamed("row", row_name)
        temp = temp.withColumn(row_name, address).join(own, row_name, "left").select(*[F.col(f"`{c}`") for c in names], hot_name)

    def drop(batch):
        where = names.index("text")
        data, at = bytes_of(batch.column(where))
        total, dropped, kept = [], [], []
        for i in range(batch.num_rows):
            text = data[at[i] : at[i + 1]].tobytes()
            rows = text.split(b"\n")
            known = everywhere.value if everywhere else frozenset(batch.column(len(names))[i].as_py() or ())
            stay = [x for x in rows if line_key(x) not in known] if known else rows
            total.append(len(rows))
            dropped.append(len(rows) - len(stay))
            kept.append(b"\n".join(stay))
        columns = [pa.array(kept, pa.binary()).cast(pa.string()) if i == where else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    temp = temp.withColumn("text", F.col("text").cast("binary"))
    fields = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in temp.schema.fields if f.name in names)
    return map_arrow(temp, drop, f"{fields}, n_lines long, n_dropped long")
