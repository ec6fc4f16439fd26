"""Target-distribution importance resampling with overlap chunking.

Features are runs of 1 to WIDTH consecutive words, hashed to buckets. A bucket's gain is the logarithm of how much more
frequent it is in the target texts than in the documents; a document's weight is the sum of the gains of its features,
and the highest weights with Gumbel noise are drawn, which is sampling without replacement in proportion to exp(weight).

A text of more than LONG_BYTES bytes is cut at word boundaries into chunks of CHUNK_WORDS words, which are dealt over all
tasks. A chunk carries the next WIDTH - 1 words along, so that features across the cut are whole, but owns only those
features that start at its own words; what its chunks find is summed by document. No task holds more of a long text than a
chunk once it is cut, and no result depends on where it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import map_arrow, require, save, tune

#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased UTF-8: digits, a-z and all characters beyond ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
WIDTH, BUCKETS = 3, 10_000
LONG_BYTES, CHUNK_WORDS = 1 << 16, 8_192
SEED, PERCENT, LEAST_WORDS = "42", 5, 20


def chunks(text: bytes, words: int = CHUNK_WORDS, width: int = WIDTH) -> Iterator[tuple[bytes, int]]:
    """(bytes, words owned) of a lower-cased text: `words` words each and width - 1 that only the next chunk owns."""
    spans: list[tuple[int, int]] = []
    for m in WORDS.finditer(text):
        spans.append(m.span())
        if len(spans) == words + width - 1:
            yield text[spans[0][0] : spans[-1][1]], words
            del spans[:words]
    if spans:
        yield text[spans[0][0] : spans[-1][1]], len(spans)


def features(chunk: bytes, owned: int | None = None, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """(buckets of the features that start at the first `owned` words, or at any, of a lower-cased chunk; those words)."""
    w = WORDS.findall(chunk)
    owned = len(w) if owned is None else owned
    spaced = [b" " + x for x in w]
    runs = [list(map(crc32, w[:owned]))]
    for k in range(1, width):  # a crc is continued by the next word; map ends where either side does
        runs.append(list(map(crc32, spaced[k:], runs[-1])))
    return np.fromiter(chain(*runs), np.int64, sum(map(len, runs))) % buckets, owned


def _cut(docs: DataFrame, width: int, long_bytes: int, chunk_words: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, chunk, owned) of the documents that are one chunk, and of the chunks of all others."""
    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    whole = docs.where(size <= long_bytes).select(F.lit(None).cast("long").alias("row"), "doc_id", text.alias("chunk"), F.lit(None).cast("int").alias("owned"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def one(batch):
        row, ids, part, chunk, owned = [], [], [], [], []
        for i in range(batch.num_rows):
            for k, (c, n) in enumerate(chunks(batch.column(2)[i].as_py().lower(), chunk_words, width)):
                row.append(batch.column(0)[i])
                ids.append(i)
                part.append(k)
                chunk.append(c)
                owned.append(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([r.as_py() for r in row], pa.int64()), batch.column(1).take(pa.array(ids, pa.int64())), pa.array(part, pa.int64()), pa.array(chunk, pa.binary()), pa.array(owned, pa.int32())],
            ["row", "doc_id", "part", "chunk", "owned"],
        )

    # a row's number is written before anything is dealt out, so that it holds when a lost task runs again
    long = docs.where(size > long_bytes).select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    cut = save(map_arrow(long, one, f"row long, doc_id {doc_type}, part long, chunk binary, owned int", rows=1))
    # a long text without a word has no chunk
    bare = docs.where(size > long_bytes).where(~F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    none = bare.select(F.lit(None).cast("long").alias("row"), "doc_id", F.lit(b"").alias("chunk"), F.lit(None).cast("int").alias("owned"))
    return whole.unionByName(none), cut.repartition("row", "part").drop("part")


def _bucket_counts(cut: DataFrame, width: int, buckets: int) -> np.ndarray:
    """Features in each bucket; a task sends one row a bucket."""
    tune(cut.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk, owned in zip(batch.column(0), batch.column(1), strict=True):
                if chunk.is_valid:
                    total += np.bincount(features(chunk.as_py().lower(), owned.as_py(), width, buckets)[0], minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = cut.select("chunk", "owned").mapInArrow(run, "bucket long, n long")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    k = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def _weighed(cut: DataFrame, gain: np.ndarray, width: int) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of each chunk."""
    shared = cut.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket
    doc_type = cut.schema["doc_id"].dataType.simpleString()

    def one(batch):
        table, n_words, n_features, weight = shared.value, [], [], []
        for chunk, owned in zip(batch.column(2), batch.column(3), strict=True):
            f, n = features((chunk.as_py() or b"").lower(), owned.as_py(), width, len(table))
            n_words.append(n)
            n_features.append(len(f))
            weight.append(int(table[f].sum()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["row", "doc_id", "n_words", "n_features", "weight"]
        )

    return map_arrow(cut, one, f"row long, doc_id {doc_type}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, width: int = WIDTH, buckets: int = BUCKETS, seed: str = SEED,
    long_bytes: int = LONG_BYTES, chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_features, n_chunks, weight, score, rank (all but doc_id long) of every row of docs.

    docs: doc_id, text; target: text. rank is 1, 2, 3, ... for the floor(percent / 100 * N) highest scores of the N rows
    of least_words words or more, equal scores by ascending doc_id, and null for all others. The noise of a score depends
    on seed and doc_id alone. A null or empty text has no features and weight 0, and so have texts without words. A null
    doc_id counts as '' in the noise and comes last among equal scores; repeated rows are rows of their own, the order
    among them is any. Very long texts are read whole, in chunks. Other columns are not read. An empty docs gives an
    empty result; with an empty target every feature is smoothed alike there.
    """
    base = require(docs, "doc_id", "text")
    whole, long = _cut(base, width, long_bytes, chunk_words)
    aim, aim_long = _cut(require(target, "text").select(F.lit(None).cast("long").alias("doc_id"), "text"), width, long_bytes, chunk_words)
    both = [_bucket_counts(a.unionByName(b), width, buckets) for a, b in ((whole, long), (aim, aim_long))]
    gain = gains(*both)
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    found = _weighed(whole, gain, width).select("doc_id", "n_words", "n_features", F.lit(1).cast("long").alias("n_chunks"), "weight")
    found = found.unionByName(_weighed(long, gain, width).groupBy("row", "doc_id").agg(*sums, F.count("*").alias("n_chunks")).drop("row"))

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    found = save(found.withColumn("score", F.col("weight") + noise))
    # ranks without a window over all rows: rows in the order of their ranks, a range a task, and a running sum over the ranges
    may = F.col("n_words") >= least_words
    tie = found.withColumn("tie", F.monotonically_increasing_id())
    order = [may.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    ordered = tie.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ordered = save(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.count(F.when(may, 1)).alias("n_may")).orderBy("part").collect()  # a row a range
    before, starts = 0, []
    for p in parts:
        starts.append((p["part"], before))
        before += p["n"]
    draw = percent * sum(p["n_may"] for p in parts) // 100
    start = ordered.sparkSession.createDataFrame(starts, "part int, start long")
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1  # the low bits count the rows of a range
    out = ordered.join(F.broadcast(start), "part").withColumn("rank", F.when(place <= draw, place))
    return out.select("doc_id", "n_words", "n_features", "n_chunks", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that resample() draws, with all their columns; rows of the same doc_id are drawn together."""
    wanted = save(resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct())
    return docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")
