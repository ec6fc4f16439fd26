"""What the corpus operators share: tables in the shared folder, vectorised words, connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, [\x20\x09-\x0D]; also what bytes.split() splits at.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPACE_CHARS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space and all ASCII characters but letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes from which an Arrow batch ends; texts may be long, so a number of rows is no bound.
BATCH_BYTES = 1 << 20
#: Bytes that the vectorised hashing handles at once; it takes about 40 times as much memory.
PIECE = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (in tests only) a folder of this machine's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_dir()
    return found.rstrip("/")


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="pairwright-")


def save(df: DataFrame, *by: str) -> DataFrame:
    """Writes df to the shared folder (in folders by some columns) and reads it again: lineage ends here, and a lost executor costs no recomputing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairwright/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairwright_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of save() that no later step reads."""
    for df in tables:
        if path := getattr(df, "_pairwright_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, for texts of any length. The setting stays with the session; no result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def require(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns never clash with an operator's own."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if len(column) == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])), off - off[0]


def arrow_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    off = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), (off - off[0]).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits (two multiply-xorshift steps)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x5851F42D4C957F2D)
_VALUE = mix(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(0x1234567))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64 that a piece needs: 4 MB."""
    out = []
    for step in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        x = np.full(PIECE + 1, step, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A polynomial hash modulo 2^64 of the bytes (as value says) of each stretch; stretches ascend and do not overlap."""
    power, inverse = _powers()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        if int(ends[i]) - at > PIECE:  # a stretch of several pieces
            total = 0
            for k, x in enumerate(range(at, int(ends[i]), PIECE)):
                part = value[data[x : min(x + PIECE, int(ends[i]))]]
                total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), k * PIECE, 1 << 64)
            out[i] = (total + int(ends[i]) - at) & 0xFFFFFFFFFFFFFFFF
            i += 1
            continue
        j = int(np.searchsorted(ends, at + PIECE, "right"))
        to = int(ends[j - 1])
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum(value[data[at:to]] * power[: to - at], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of each word, word offsets per text). A-Z counts as a-z; a word never spans two texts."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return mix(stretch_hashes(data, starts, ends, _VALUE)), starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int, word_rank: np.ndarray | None = None):
    """(hashes, offsets per text) of word shingles, in text order and with repeats; fewer words make one shingle.

    With word_rank (a number for each low part of a word's hash, its length a power of two) also the sum of a shingle's ranks.
    """
    h, _, _, at = words(data, offsets)
    count = np.diff(at)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    first = np.repeat(at[:-1], made) + np.arange(to[-1]) - np.repeat(to[:-1], made)
    size = np.minimum(np.repeat(count, made), width)
    x = np.full(len(first), 0x51ED270B, np.uint64) + size.astype(np.uint64)
    for k in range(width):
        has = size > k
        nxt = np.where(has, h[np.minimum(first + k, len(h) - 1)] if len(h) else np.zeros(len(first), np.uint64), np.uint64(0))
        x = mix(x * np.uint64(0x9FB21C651E98DF25) + nxt)
    if word_rank is None:
        return x, to
    total = np.concatenate([[0], np.cumsum(word_rank[(h & np.uint64(len(word_rank) - 1)).astype(np.int64)])]).astype(np.int64)
    return x, to, total[first + size] - total[first]


def give_back() -> None:
    """Returns freed memory of this Python worker to the system; workers are used again by later stages, and an allocator
    keeps what is freed between blocks in use."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_arrow(df: DataFrame, function, schema: str, rows: int | None = None) -> DataFrame:
    """mapInArrow with small batches (of at most so many rows, if given). function: RecordBatch -> RecordBatch or None."""
    tune(df.sparkSession)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, rows or max(1, whole.num_rows)):
                if (out := function(whole.slice(k, rows))) is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


#: Ids that are broadcast at most.
BROADCAST_IDS = 500_000


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows but those whose doc_id is in ids (one column, doc_id). Few ids go to the rows, many meet them by a shuffle."""
    name = free_name(rows, "id")
    ids = save(ids.where("doc_id is not null").distinct().withColumnRenamed("doc_id", name))
    return rows.join(small(ids), F.col("doc_id") == F.col(name), "left_anti")


def small(table: DataFrame) -> DataFrame:
    """A table of save() of few numbers a row, marked for broadcast if it has BROADCAST_IDS rows at most."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of the edges (a, b): component is the smallest id that can be reached.

    Alternates large-star and small-star (Kiveris et al. 2014); each round is grouped minima and joins with the few nodes
    that have something to pass on (inner nodes of paths, and nodes with several smaller neighbours), broadcast if
    their count allows it, so a hub's edges are nowhere brought together; beyond that count the join is by a shuffle,
    which adaptive execution can split at a hub. Every round leaves a table in the shared folder.
    """
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(t):
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(e)
    while seen[0]:
        # large star: the larger neighbours of v go to the smallest neighbour of v, or to v itself
        inner = save(e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v").join(e.select("v").distinct(), "v"))
        large = save(e.join(small(inner), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        forks = save(low.where("n > 1").select("u", "m"))
        moved = large.join(small(forks), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = save(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(new)
        forget(e, inner, large, forks)
        e = new
        if now == seen:
            break
        seen = now
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
