"""Ranked lexical search over a clustered index, with documents in an order found by recursive graph bisection.

The order: a bounded sample of documents is bisected LEVELS times; at each level documents change sides in pairs as long as
that lowers the estimated gaps between the documents of a term. Every document of the corpus then goes down the same
splits, to the side where its terms cost less, so documents that share terms come to lie in one cluster.

The index: the documents of a cluster are dealt to shards of about SHARD_DOCS. A shard holds inverted blocks (by term: which documents,
how often) and for each term the greatest score that one occurrence list can give there. The sum of these over an item's terms bounds
every score of the shard. Items visit their shards from the highest bound down, in rounds that grow fourfold, and stop exactly
when no shard left has a bound as high as the item's K-th score (a shard of an equal bound is visited, for the order of doc_id decides there).
Blocks keep doc_ids, so equal scores are ordered by doc_id and not by the place in the index.

All scores are 64-bit integers. Items are handled in groups of about ITEM_BYTES bytes of text, by whose terms the index is restricted.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import arrow_lists, forget, lists, map_arrow, require, save, tune

#: Terms of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` once A-Z are lower-cased, in UTF-8.
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
K, NORM, SLOPE, SCALE = 10, 100, 90, 1_000_000_000
LEVELS, SAMPLE_DOCS, SAMPLE_POSTINGS, SWAPS = 7, 8_000, 2_000_000, 12
SHARD_DOCS = 512
ITEM_BYTES = 8 << 20
#: Shards that an item visits in the first round, and the growth of a round.
FIRST, GROWTH = 4, 4


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The whole numbers from each start on, so many each."""
    to = np.cumsum(counts)
    return np.repeat(starts - to + counts, counts) + np.arange(to[-1] if len(to) else 0)


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with terms: terms of the vocabulary ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of at most about ITEM_BYTES of text

    def one(batch):
        number, n, keep, terms, counts, off = shared.value, [], [], [], [], [0]
        for i in range(batch.num_rows):
            found = TERMS.findall((batch.column(1)[i].as_py() or b"").lower())
            if not found:
                continue
            own = sorted((number[w], c) for w, c in Counter(found).items() if w in number)
            keep.append(i)
            n.append(len(found))
            terms.extend(t for t, _ in own)
            counts.extend(c for _, c in own)
            off.append(len(terms))
        at = np.asarray(off)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), arrow_lists(np.asarray(terms, np.int32), at), arrow_lists(np.asarray(counts, np.int64), at)],
            ["doc_id", "n", "terms", "counts"],
        )

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), one, f"doc_id {doc_type}, n long, terms array<int>, counts array<long>")


def bisect(offsets: np.ndarray, terms: np.ndarray, levels: int = LEVELS, swaps: int = SWAPS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Splits documents (their terms from offsets[i] to offsets[i + 1]) in halves, levels times.

    Returns for each level (keys, lean): keys are node << 32 | term, ascending, and lean is what a document with that term saves
    on the right side of the node; and the node of each document after the last level.
    """
    size = len(offsets) - 1
    doc = np.repeat(np.arange(size), np.diff(offsets))
    node = np.zeros(size, np.int64)
    out = []
    for level in range(levels):
        keys, at = np.unique((node[doc] << 32) | terms, return_inverse=True)
        # halves of each node, in the order in which its documents come
        order = np.argsort(node, kind="stable")
        begin = np.searchsorted(node[order], np.arange(1 << level))
        many = np.bincount(node, minlength=1 << level)
        place = np.empty(size, np.int64)
        place[order] = np.arange(size) - begin[node[order]]
        right = place >= (many[node] + 1) // 2
        total = np.bincount(at, minlength=len(keys))
        n_left = np.maximum(np.bincount(node[~right], minlength=1 << level), 1)[keys >> 32]
        n_right = np.maximum(np.bincount(node[right], minlength=1 << level), 1)[keys >> 32]
        for _ in range(swaps):
            on_right = np.bincount(at[right[doc]], minlength=len(keys))
            lean = np.log2(n_left / (total - on_right + 1)) - np.log2(n_right / (on_right + 1))
            gain = np.bincount(doc, lean[at], minlength=size)  # what it saves to be on the right
            # the documents of a node that gain most by a change, in pairs; a pair changes if both together gain
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            a, b = a[np.lexsort((-gain[a], node[a]))], b[np.lexsort((gain[b], node[b]))]
            first_a, first_b = np.searchsorted(node[a], np.arange(1 << level)), np.searchsorted(node[b], np.arange(1 << level))
            k = np.arange(len(a)) - first_a[node[a]]
            has = k < np.bincount(node[b], minlength=1 << level)[node[a]]
            a, other = a[has], b[first_b[node[a[has]]] + k[has]]
            swap = gain[a] - gain[other] > 0
            if not swap.any():
                break
            right[a[swap]], right[other[swap]] = True, False
        on_right = np.bincount(at[right[doc]], minlength=len(keys))
        lean = np.log2(n_left / (total - on_right + 1)) - np.log2(n_right / (on_right + 1))
        out.append((keys, lean.astype(np.float32)))
        node = 2 * node + right
    return out, node


def clusters(splits: list[tuple[np.ndarray, np.ndarray]], offsets: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The node that each document comes to by the splits; without any known term, the leftmost."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    node = np.zeros(len(offsets) - 1, np.int64)
    for keys, lean in splits:
        wanted = (node[doc] << 32) | terms
        if len(keys):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            saved = np.bincount(doc, np.where(keys[at] == wanted, lean[at], 0), minlength=len(node))
        else:
            saved = np.zeros(len(node))
        node = 2 * node + (saved > 0)
    return node


def _fit(postings: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Splits learned from SAMPLE_DOCS documents at most (the smallest hashes of what they hold), with SAMPLE_POSTINGS terms at most."""
    total, wide = postings.agg(F.count("*"), F.max(F.size("terms"))).first()
    if not total:
        return []
    most = min(SAMPLE_DOCS, max(1, SAMPLE_POSTINGS // max(1, wide)))
    place = F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 40))
    rows = postings.where(place < int((1 << 40) * min(1.0, 1.5 * most / total))).orderBy(place, "doc_id").select("terms").limit(most).toArrow()
    values, off = lists(rows["terms"].combine_chunks()) if rows.num_rows else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    return bisect(off, values.astype(np.int64))[0]


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """A document's m: NORM - SLOPE + SLOPE * n * docs div terms."""
    if len(n) and int(n.max()) * SLOPE * docs >= 1 << 63:  # beyond 64 bits for a document of very many terms
        return np.array([NORM - SLOPE + SLOPE * int(x) * docs // terms for x in n], np.int64)
    return NORM - SLOPE + SLOPE * n * docs // terms


def _blocks(postings: DataFrame, splits, docs: int, terms: int) -> DataFrame:
    """Inverted blocks (cluster, shard, docs, terms, starts, places, gains, best); the documents of a block are of one shard."""
    shared = postings.sparkSession.sparkContext.broadcast(splits)  # SAMPLE_POSTINGS keys a level at most
    doc_type = postings.schema["doc_id"].dataType.simpleString()

    def placed(batch):
        values, off = lists(batch.column(2))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(clusters(shared.value, off, values.astype(np.int64)), pa.int64())], [*batch.schema.names, "cluster"])

    own = save(map_arrow(postings, placed, f"doc_id {doc_type}, n long, terms array<int>, counts array<long>, cluster long"))
    many = own.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD_DOCS).alias("parts"))  # a row a cluster, 1 << LEVELS at most
    sub = F.pmod(F.xxhash64("doc_id", "n", F.col("terms")), F.col("parts"))
    dealt = own.join(F.broadcast(many), "cluster").withColumn("sub", sub).repartition("cluster", "sub").sortWithinPartitions("cluster", "sub", F.col("doc_id").asc_nulls_last()).drop("parts")

    def inverted(batch):
        key = np.stack([batch.column(k).to_numpy() for k in (4, 5)])
        cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        out = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            rows = batch.slice(i, j - i)
            values, off = lists(rows.column(2))
            tf = lists(rows.column(3))[0]
            m = lengths(rows.column(1).to_numpy(), docs, terms)
            place = np.repeat(np.arange(j - i), np.diff(off))
            order = np.argsort(values, kind="stable")
            gain = (SCALE * tf // (1000 * tf + 8 * m[place]))[order]
            kinds, first = np.unique(values[order], return_index=True)
            best = np.maximum.reduceat(gain, first) if len(first) else gain
            out.append((int(key[0, i]), int(key[1, i]), rows.column(0), kinds, np.append(first, len(values)), place[order], gain, best))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), batch.column(0)),
                *(pa.array([x[k] for x in out], pa.list_(t)) for k, t in ((3, pa.int32()), (4, pa.int32()), (5, pa.int32()), (6, pa.int32()), (7, pa.int32()))),
            ],
            ["cluster", "shard", "docs", "terms", "starts", "places", "gains", "best"],
        )

    schema = f"cluster long, shard long, docs array<{doc_type}>, terms array<int>, starts array<int>, places array<int>, gains array<int>, best array<int>"
    out = save(map_arrow(dealt.select("doc_id", "n", "terms", "counts", "cluster", "sub"), inverted, schema))
    forget(own)
    return out


class Items:
    """Items of one group as arrays: the terms of item i (numbers of the vocabulary, weights w) from at[i] to at[i + 1]."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, at: np.ndarray):
        self.terms, self.weights, self.at = terms, weights, at

    def of(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position among `items`, term, weight) of their terms."""
        counts = self.at[items + 1] - self.at[items]
        where = ranges(self.at[items], counts)
        return np.repeat(np.arange(len(items)), counts), self.terms[where], self.weights[where]


def _bounds(blocks: DataFrame, items) -> DataFrame:
    """(q, cluster, shard, bound) above 0: the greatest score that a document of the shard could have for item q."""

    def one(batch):
        it = items.value
        owner, term, weight = it.of(np.arange(len(it.at) - 1))
        cluster, shard, q, bound = [], [], [], []
        for i in range(batch.num_rows):
            own, best = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
            if len(own) == 0:
                continue
            at = np.minimum(np.searchsorted(own, term), len(own) - 1)
            total = np.zeros(len(it.at) - 1, np.int64)
            np.add.at(total, owner, np.where(own[at] == term, best[at].astype(np.int64) * weight, 0))
            has = np.flatnonzero(total)
            q.append(has)
            bound.append(total[has])
            cluster.append(np.full(len(has), batch.column(0)[i].as_py()))
            shard.append(np.full(len(has), batch.column(1)[i].as_py()))
        if not q:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (q, cluster, shard, bound)], ["q", "cluster", "shard", "bound"])

    found = map_arrow(blocks.select("cluster", "shard", "terms", "best"), one, "q long, cluster long, shard long, bound long")
    return save(found.groupBy("q", "cluster", "shard").agg(F.max("bound").alias("bound")))  # a shard may have several blocks


def _visit(blocks: DataFrame, visits: DataFrame, items, k: int) -> DataFrame:
    """(q, doc_id, score): the k best of each block for the items that visit its shard."""
    doc_type = blocks.schema["docs"].dataType.elementType.simpleString()
    wanted = visits.groupBy("cluster", "shard").agg(F.sort_array(F.collect_list("q")).alias("items"))  # items of a group at most

    def one(batch):
        q_out, id_out, score_out = [], [], []
        for i in range(batch.num_rows):
            ids = batch.column(0)[i].values
            own, starts, places, gains, items_here = (batch.column(c)[i].values.to_numpy() for c in range(1, 6))
            owner, term, weight = items.value.of(items_here)
            at = np.minimum(np.searchsorted(own, term), max(len(own) - 1, 0))
            has = own[at] == term if len(own) else np.zeros(len(term), bool)
            owner, weight, at = owner[has], weight[has], at[has]
            for j, q in enumerate(items_here):
                lo, hi = np.searchsorted(owner, [j, j + 1])
                first, count = starts[at[lo:hi]], starts[at[lo:hi] + 1] - starts[at[lo:hi]]
                which = ranges(first, count)
                score = np.zeros(len(ids), np.int64)
                np.add.at(score, places[which], gains[which] * np.repeat(weight[lo:hi], count))
                top = np.argsort(-score, kind="stable")[:k]  # ids of a block ascend, so the stable order is that of ties
                top = top[score[top] > 0]
                q_out.append(np.full(len(top), q))
                id_out.append(ids.take(pa.array(top)))
                score_out.append(score[top])
        if not q_out:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(q_out), pa.int64()), pa.concat_arrays(id_out), pa.array(np.concatenate(score_out), pa.int64())], ["q", "doc_id", "score"]
        )

    rows = blocks.drop("best").join(wanted, ["cluster", "shard"]).select("docs", "terms", "starts", "places", "gains", "items")
    return map_arrow(rows, one, f"q long, doc_id {doc_type}, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(q, doc_id, score, rank): Spark cuts each task's rows to k an item before they are brought together."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, items: DataFrame, k: int, visited: list | None) -> DataFrame | None:
    """(q, doc_id, score, rank) of one group of items (q, text)."""
    spark = docs.sparkSession
    texts = [(r["q"], Counter(TERMS.findall(bytes(r["text"] or b"").lower()))) for r in items.select("q", F.col("text").cast("binary").alias("text")).collect()]  # about ITEM_BYTES
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(t for _, t in texts))))}
    if not vocabulary:
        return None
    postings = save(_postings(docs, vocabulary))
    n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)

    def frequencies(batches):
        total = np.zeros(len(df), np.int64)
        for batch in batches:
            total += np.bincount(lists(batch.column(0))[0], minlength=len(total))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["term", "df"])

    tune(spark)
    for r in postings.select("terms").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a word of the items
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * (n_docs or 0) + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    numbers = [np.array(sorted(vocabulary[w] for w in t), np.int64) for _, t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
    all_terms = np.concatenate(numbers)
    shared = spark.sparkContext.broadcast(Items(all_terms, weight[all_terms], at))  # about ITEM_BYTES
    blocks = _blocks(postings, _fit(postings), n_docs, n_terms)
    forget(postings)
    bounds = _bounds(blocks, shared)
    shards = bounds.count()

    best, take = None, FIRST
    left = bounds.withColumn("floor", F.lit(1).cast("long"))
    while True:
        order = Window.partitionBy("q").orderBy(F.col("bound").desc(), "cluster", "shard")
        visits = save(left.where("bound >= floor").withColumn("place", F.row_number().over(order)).where(F.col("place") <= take).select("q", "cluster", "shard"))
        many = visits.count()
        if visited is not None:
            visited.append((many, shards))
        if not many:
            break
        found = _visit(blocks, visits, shared, k)
        before, best = best, save(_best(found if best is None else found.unionByName(best.drop("rank")), k).coalesce(8))
        # an item that has k documents needs no shard whose bound is below the last of them
        low = best.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(1).alias("floor"))
        rest = save(left.drop("floor").join(visits, ["q", "cluster", "shard"], "left_anti").join(F.broadcast(low), "q", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long"))).where("bound >= floor"))
        forget(visits, *([before] if before is not None else []), *([left] if take > FIRST else []))
        left, take = rest, take * GROWTH
    forget(blocks, bounds)
    names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(texts)], "q long, row long")
    return None if best is None else best.join(F.broadcast(names), "q").select(F.col("row").alias("q"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, visited: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0 (all, if fewer).

    docs: doc_id, text; items: item_id, text. Equal scores are ordered by ascending doc_id, a null doc_id last, repeated rows of a doc_id
    one after the other. Every row of items is an item of its own, whatever its item_id. Null and empty texts have no
    terms: such items find nothing, such documents are not found and count in no statistic. Very long texts are read
    whole. Other columns are not read. Without docs or items the result is empty. With `visited`, a list, each round adds (pairs of item
    and shard visited, all such pairs with a bound above 0). The bisection learns from a sample (SAMPLE_DOCS, SAMPLE_POSTINGS); every row is indexed.
    """
    docs = require(docs, "doc_id", "text")
    asked = save(require(items, "item_id", "text").withColumn("q", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = size // ITEM_BYTES + 1
    out = None
    for g in range(groups):
        found = _search(docs, asked.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g), k, visited)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        ids = [f"{c} {t[c].dataType.simpleString()}" for c, t in (("item_id", asked.schema), ("doc_id", docs.schema))]
        return docs.sparkSession.createDataFrame([], f"{ids[0]}, rank int, {ids[1]}, score long")
    return asked.select("q", "item_id").join(out, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
