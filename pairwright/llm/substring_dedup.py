"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes; a chunk ends where the hash is the least of SPAN in a row. The choice depends on the
bytes nearby only, so an insertion moves at most the chunks around it, and of any SPAN places in a row one is a cut, so
no passage, however its bytes fall, loses more than EDGE bytes at each end. Chunks are deduplicated by digest: the
document with the smallest id that holds a chunk is its first, every other occurrence is a repeat. Consecutive chunks
that other documents hold too make a span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import PIECE, SPACE, bytes_of, map_arrow, mix, require, save, stretch_hashes

#: Bytes that a hash depends on, and places of which the one with the least hash is a cut.
WINDOW, SPAN = 12, 48
#: Bytes at each end of a repeated passage that may lie in chunks reaching beyond it; also the longest chunk.
EDGE = WINDOW + SPAN - 1
#: Places of the same hash that are nearer than this, as in text of one repeated word, are cut once.
SPACING = 16
#: Words that a span of repeated chunks has at least. Passages of 51 words keep as many without the EDGE bytes at both ends
#: if a word and its space take 5.4 bytes on average; few passages lose that much.
MIN_WORDS = 28
GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0xC0FFEE)) >> np.uint64(32)).astype(np.uint32)
_VALUES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0xABCDEF))


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks (exclusive) of the texts in data, ascending; every text's end is among them."""
    n = len(data)
    # rows of SPAN hashes, each of WINDOW bytes, that lie in one text, by the place of their first hash
    change = np.zeros(n + 1, np.int32)
    first, last = offsets[:-1] + WINDOW - 1, offsets[1:] - SPAN + 1
    some = last > first
    change[first[some]] += 1
    np.subtract.at(change, last[some], 1)
    inside = np.cumsum(change[:n]) > 0
    places, hashes = [], []
    for at in range(0, n, PIECE):
        to = min(at + PIECE, n)
        lead = max(0, at - SPAN - WINDOW + 2)
        h = np.maximum(_gear(data[lead : min(to + SPAN - 1, n)]), np.uint32(1))
        if len(h) < SPAN:
            continue
        least = np.where(inside[lead : lead + len(h) - SPAN + 1], _sliding(h, np.minimum), np.uint32(0))
        edge = np.zeros(SPAN - 1, np.uint32)
        # a place is a cut if one of the rows that hold it has no smaller hash
        hit = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), np.maximum) == h)
        hit = hit[(hit >= at - lead) & (hit < to - lead)]
        places.append(hit + lead)
        hashes.append(h[hit])
    if not places:
        return np.unique(offsets[1:][offsets[1:] > 0])
    place, value = np.concatenate(places), np.concatenate(hashes)
    cuts = np.unique(np.concatenate([_thin(place, value, offsets) + 1, offsets[1:]]))
    return cuts[cuts > 0]


def _gear(data: np.ndarray) -> np.ndarray:
    g = GEAR[data]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint32(k)
    return h


def _sliding(x: np.ndarray, extreme: np.ufunc) -> np.ndarray:
    """The extreme of each SPAN values in a row, by doubling."""
    size = 1
    while size < SPAN:
        step = min(size, SPAN - size)
        x = extreme(x[:-step], x[step:])
        size += step
    return x


def _thin(place: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places but those that follow one of the same hash in the same text by less than SPACING.

    In periodic text they are a period apart, so its chunks are the same wherever it begins."""
    text = np.searchsorted(offsets, place, "right")
    near = (value[1:] == value[:-1]) & (np.diff(place) < SPACING) & (text[1:] == text[:-1])
    if not near.any():
        return place
    begins = np.flatnonzero(np.concatenate([[True], ~near]))
    keep = np.zeros(len(place), bool)
    keep[begins] = True
    for a, b in zip(begins, np.append(begins[1:], len(place)), strict=True):
        if b - a > 1:
            k = a
            while (k := int(np.searchsorted(place[a:b], place[k] + SPACING)) + a) < b:
                keep[k] = True
    return place[keep]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start and end within the text, digest, words that begin in it) of every chunk, in order."""
    ends = cut_points(data, offsets)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    digest = stretch_hashes(data, starts, ends, _VALUES)
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] = solid[first]
    counts = np.concatenate([[0], np.cumsum(begin)])
    text = np.searchsorted(offsets, starts, "right") - 1
    return text, starts - offsets[text], ends - offsets[text], mix(digest), counts[ends] - counts[starts]


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with passages that other documents hold too, and where they are; documents without are left out.

    docs: doc_id, text; other columns are ignored, whatever their names. Result, one row for each such doc_id: doc_id,
    n_spans, n_repeated (bytes in the spans), n_dropped (bytes of them whose first document is another one), spans
    (array of start, end in UTF-8 bytes, end exclusive, and dropped: bytes to drop of it), partners (first documents of
    its chunks, itself left out, distinct). Every passage of which min_words words are left without EDGE bytes at each end
    is found. Digests have 64 bits and are not compared as texts: a false span needs several false chunks in a row. Null, empty and blank texts have no passages. Rows with a null doc_id are
    left aside, as nothing could name them; rows with equal doc_id are one document, whose repeats of itself do not
    count. Texts are chunked whole. An empty table gives an empty result.
    """
    docs = require(docs, "doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))

    def one(batch):
        text, start, end, digest, n = chunks(*bytes_of(batch.column(1)))
        ids = batch.column(0).to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(digest.view(np.int64)), pa.array(ids[text]), pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(n.astype(np.int32))], ["digest", "doc_id", "start", "size", "words"]
        )

    pieces = map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), one, "digest long, doc_id long, start int, size int, words int")
    several = pieces.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    several = save(several)  # a join can be split at a frequent chunk only if both its sides come straight from a shuffle
    shared = pieces.join(several, "digest").select("doc_id", "start", "size", "words", "first")
    # chunks that follow each other make a run; a document's chunks are as many as its text has
    per_doc = shared.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "size", "words", "first"))).alias("c"))

    def merge(batch):
        rows = []
        for doc, cs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = cs.values
            start, size, n, first = (v.field(k).to_numpy() for k in range(4))
            cut = np.flatnonzero(start[1:] != start[:-1] + size[:-1]) + 1
            at = np.concatenate([[0], cut]).astype(np.int64)
            total = np.add.reduceat(n, at)
            keep = np.flatnonzero(total >= min_words)
            if len(keep) == 0:
                continue
            to = np.append(at[1:], len(start))
            spans, partners = [], set()
            for k in keep.tolist():
                own = slice(at[k], to[k])
                away = first[own] != doc
                partners.update(first[own][away].tolist())
                spans.append({"start": int(start[at[k]]), "end": int(start[to[k] - 1] + size[to[k] - 1]), "dropped": int(size[own][away].sum())})
            rows.append({"doc_id": doc, "n_spans": len(spans), "n_repeated": sum(s["end"] - s["start"] for s in spans), "n_dropped": sum(s["dropped"] for s in spans), "spans": spans, "partners": sorted(partners)})
        return pa.RecordBatch.from_pylist(rows, out) if rows else None

    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("dropped", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("n_spans", pa.int64()), ("n_repeated", pa.int64()), ("n_dropped", pa.int64()), ("spans", pa.list_(span)), ("partners", pa.list_(pa.int64()))])
    return map_arrow(per_doc, merge, "doc_id long, n_spans long, n_repeated long, n_dropped long, spans array<struct<start:long,end:long,dropped:long>>, partners array<long>")
