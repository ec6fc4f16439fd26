"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of PASSAGE words with MARGIN words of context on both sides, items as pieces
of up to PASSAGE words. A match needs a common subsequence of LOOSE of a piece's words within a context, and both gates
follow from that number alone, so neither can drop a match. Of the piece's n words all but the n - need + k most common
ones can be left aside: k of the rest have to be in the context (HITS), which is sought first; then all words that the
decision asks for, in any order. Passages that no piece reaches in this way go no further. The others are TF-IDF vectors over the benchmark's terms; document frequencies are counted over all passages of
all documents in a sketch of fixed size. A distributed randomised SVD of these rows, items included, gives the latent
space: each partition adds up its part of A'(A W), which is of fixed size. A product of two vectors is at most that of
their latent images and that of the lengths of what the space leaves out; pairs whose product cannot reach the weight of
the piece's lightest words that make up LOOSE are dropped. The longest common subsequence of words with the item's
piece, and for looser matches the item's answer, decide.

An item of under SHORT words is sought as a phrase: all its words, one after the other.

Pieces are taken in blocks, each with its own terms and latent space. A block has a bounded number of pieces of bounded
length; one reading of the documents serves SCAN blocks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import NOT_WORD, bytes_of, forget, give_back, map_arrow, require, save, without_ids, words

PASSAGE, STEP, ITEM_STEP = 32, 8, 16
#: Words of a piece's rarer part that have to be in a context; any number drops no match, fewer let more pairs through.
HITS = 4
CELLS = 1 << 18
#: Pieces of a block, and blocks that one reading of the documents serves.
PIECES, SCAN = 512, 16
#: Items of fewer words are sought as a phrase.
SHORT = 4
RANK, OVER, SEED = 192, 16, 5
#: For the rounding of single precision in the bound on a product.
SLACK = 1e-3
#: Common subsequence, of the words of an item's passage, that decides alone, and that decides if the answer is there too.
CLEAR, LOOSE, ANSWERED = 0.75, 0.5, 0.8
#: Words of context on both sides of a passage in which the subsequence is sought.
MARGIN = 16
ROWS = 256
#: Rows that are multiplied at once, as a matrix over the terms that they hold.
FEW = 64
#: Contexts whose words are marked at once, and partial sums that one task adds up.
CONTEXTS, SUMS = 1024, 64
#: Words whose meetings with the pieces are listed at once: of several documents, or a stretch of a longer one. Stretches
#: overlap by more than a context.
GROUP, OVERLAP = 1 << 16, PASSAGE + 2 * MARGIN + 2 * STEP


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 with the capitals from A grave to thorn in lower case (their second byte after C3); A-Z are left to words()."""
    out = data.copy()
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[up] += 0x20
    return out


def words_of(data: np.ndarray, offsets: np.ndarray):
    return words(lower_latin(data), offsets, NOT_WORD)


def frequencies(docs: DataFrame) -> np.ndarray:
    """How often the words of each sketch cell occur, over all documents, and their number at last: CELLS + 1 numbers."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            h = words_of(*bytes_of(b.column(0)))[0]
            total += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])
        give_back()

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros(CELLS + 1)
    got = rows.toArrow()  # CELLS rows at most, whatever the input
    total[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    total[-1] = total.sum()
    return total


def weights(total: np.ndarray) -> np.ndarray:
    """Inverse document frequency of each cell; a passage holds a word about once."""
    passages = total[-1] / PASSAGE + 1
    return np.log(1 + passages / (1 + total[:-1])).astype(np.float32)


def pieces_of(rows: list[tuple[int, str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(item, words of a piece, words of the item's answer) of all items; items without words have none."""
    texts = [(t or "").encode("utf-8", "replace") for _, t in rows]
    h, _, _, at = words_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    out = []
    for k, (item, text) in enumerate(rows):
        w = h[at[k] : at[k + 1]]
        if len(w):
            last, answer = max(0, len(w) - PASSAGE), answer_of(text, w)
            out += [(item, w[s : s + PASSAGE], answer) for s in sorted({*range(0, last + 1, ITEM_STEP), last})]
    return out


class Items:
    """One block of pieces of benchmark items: terms, the pieces as sparse vectors, and answers."""

    def __init__(self, pieces: list[tuple[int, np.ndarray, np.ndarray]], idf: np.ndarray):
        self.ids, self.words, self.answers = map(list, zip(*pieces, strict=True))
        self.terms = np.unique(np.concatenate(self.words))
        self.term_idf = idf[(self.terms & np.uint64(CELLS - 1)).astype(np.int64)]
        rows = [np.unique(np.searchsorted(self.terms, piece), return_counts=True) for piece in self.words]
        self.off = np.cumsum([0, *(len(k) for k, _ in rows)])
        self.slots, self.values = np.concatenate([k for k, _ in rows]), np.concatenate([n * self.term_idf[k] for k, n in rows]).astype(np.float64)
        norm = np.maximum(np.sqrt(np.add.reduceat(self.values**2, self.off[:-1])), 1e-9)
        self.values /= np.repeat(norm, np.diff(self.off))
        self.hits, self.least, rare = np.zeros(len(self.words), np.int64), np.zeros(len(self.words)), []
        for j, piece in enumerate(self.words):
            slot = np.searchsorted(self.terms, piece)
            slot = slot[np.argsort(self.term_idf[slot], kind="stable")]  # the common ones first
            need = needed(len(piece))
            self.hits[j] = min(HITS, need)
            self.least[j] = (self.term_idf[slot[:need]].astype(np.float64) ** 2).sum() / norm[j]
            rare.append(np.unique(slot[need - self.hits[j] :]))
            # a word that is there several times counts once among the rarer ones
            self.hits[j] = min(self.hits[j], len(rare[-1]))
        slots = np.concatenate(rare)
        order = np.argsort(slots, kind="stable")
        #: Pieces by the terms of their rarer parts: those of term t are pieces[first[t] : first[t + 1]].
        self.pieces = np.repeat(np.arange(len(rare)), list(map(len, rare)))[order]
        self.first = np.searchsorted(slots[order], np.arange(len(self.terms) + 1))
        self.bags, self.answer_bags = self.padded(self.words), self.padded(self.answers)

    def index(self, all_terms: np.ndarray) -> tuple:
        """What relevant() needs of the block; its terms by their place in all_terms."""
        slot_of = np.full(len(all_terms), -1, np.int32)
        slot_of[np.searchsorted(all_terms, self.terms)] = np.arange(len(self.terms))
        return slot_of, self.term_idf, self.first, self.pieces, self.hits, self.bags, self.answer_bags

    def padded(self, lists: list[np.ndarray]) -> np.ndarray:
        """Slots of each list's words; len(terms) after its end, len(terms) + 1 for words that are no term."""
        out = np.full((len(lists), max(map(len, lists), default=0)), len(self.terms), np.int32)
        for row, w in zip(out, lists, strict=True):
            at = np.minimum(np.searchsorted(self.terms, w), len(self.terms) - 1)
            row[: len(w)] = np.where(self.terms[at] == w, at, len(self.terms) + 1)
        return out


def needed(n: int) -> int:
    """Words that a common subsequence with a piece of n words has at least, if it decides."""
    return n if n < SHORT else next(k for k in range(n + 1) if k / n >= LOOSE)


def answer_of(text: str, w: np.ndarray) -> np.ndarray:
    """Words of the item's answer: what follows 'Answer:' or the last question mark, or else its last quarter."""
    m = re.search(r"(?is)(?:answer\s*:|\?)([^?]*)$", text or "")
    if m and (tail := m[1].strip()):
        b = tail.encode("utf-8", "replace")
        found = words_of(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        if len(found):
            return found
    return w[-max(1, len(w) // 4) :]


def places_of(a: list) -> dict:
    """The places of each word of a, as the bits of one integer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    return places


def common_subsequence(a: list, b: list, places: dict | None = None) -> int:
    """Length of the longest common subsequence, by the bits of one integer for a (Hyyro 2004); words that a lacks change nothing."""
    full = (1 << len(a)) - 1
    v = full
    for p in map((places_of(a) if places is None else places).get, b):
        if p:
            u = v & p
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def reached(slot: np.ndarray, known: np.ndarray, at: np.ndarray, first: np.ndarray, pieces: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number of passage, piece): the passages whose context holds enough of a piece's rarer part.

    slot and known: term of each word; at: word offsets of the documents.
    """
    where = np.flatnonzero(known)
    times = first[slot[where] + 1] - first[slot[where]]
    to = np.concatenate([[0], np.cumsum(times)])
    piece = pieces[np.repeat(first[slot[where]] - to[:-1], times) + np.arange(to[-1])]
    n = len(slot) + 1
    key = np.sort(piece * n + np.repeat(where, times))
    piece, place = key // n, key % n
    end = np.arange(len(key)) + hits[piece] - 1
    ok = end < len(key)
    i, end = np.flatnonzero(ok), end[ok]
    ok = (piece[i] == piece[end]) & (place[end] - place[i] < PASSAGE + 2 * MARGIN)
    i, end = i[ok], end[ok]
    doc = np.searchsorted(at, place[i], "right") - 1
    ok = place[end] < at[doc + 1]
    i, end, doc = i[ok], end[ok], doc[ok]
    # passages whose context covers both places; the last one may begin earlier than its number says
    final = -(-np.maximum(at[doc + 1] - at[doc] - PASSAGE, 0) // STEP)
    low = np.clip(-(-(place[end] + 1 - at[doc] - PASSAGE - MARGIN) // STEP), 0, final)
    high = np.minimum((place[i] - at[doc] + MARGIN) // STEP, final)
    high = np.where(high >= final - 1, final, high)
    made = high - low + 1
    to = np.concatenate([[0], np.cumsum(made)])
    number = np.repeat(low - to[:-1], made) + np.arange(to[-1])
    # one number for the three; the pieces of a block are few
    all_numbers = int(final.max(initial=0)) + 1
    code = np.unique((np.repeat(doc, made) * all_numbers + number) * len(hits) + np.repeat(piece[i], made))
    passage = code // len(hits)
    return passage // all_numbers, passage % all_numbers, code % len(hits)


def decidable(slot: np.ndarray, known: np.ndarray, begin: np.ndarray, end: np.ndarray, context: np.ndarray, piece: np.ndarray, terms: int, bags: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Which of the contexts (their number, ascending; words begin to end) and pieces have the words that matches() asks for, in any order."""
    out = np.zeros(len(piece), bool)
    new = np.flatnonzero(np.diff(context, prepend=-1))
    which = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(piece))))
    size, asked = (bags != terms).sum(1), (answers != terms).sum(1)
    for k in range(0, len(new), CONTEXTS):
        some = new[k : k + CONTEXTS]
        s, e = begin[some], end[some]
        has = np.zeros((len(some), terms + 2), np.uint8)
        has[:, terms + 1] = 1
        to = np.concatenate([[0], np.cumsum(e - s)])
        at = np.repeat(s - to[:-1], e - s) + np.arange(to[-1])
        row = np.repeat(np.arange(len(some)), e - s)
        has[row[known[at]], slot[at[known[at]]]] = 1
        flat = has.ravel()
        a, b = int(some[0]), int(new[k + CONTEXTS]) if k + CONTEXTS < len(new) else len(piece)
        j, base = piece[a:b], (which[a:b] - k) * (terms + 2)
        share = flat[base[:, None] + bags[j]].sum(1, dtype=np.int64) / size[j]
        out[a:b] = share >= CLEAR
        loose = np.flatnonzero((share >= LOOSE) & (share < CLEAR))
        there = flat[base[loose][:, None] + answers[j[loose]]].sum(1, dtype=np.int64)
        out[a + loose] = there >= ANSWERED * asked[j[loose]]
    return out


def stretches(at: np.ndarray):
    """(first document, word bounds) of about GROUP words: bounds of whole documents, or of a stretch of one document."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + GROUP, "right")) - 1)
        if at[j] - at[i] <= GROUP:
            yield i, at[i : j + 1]
        else:
            for s in range(int(at[i]), int(at[j]) - OVERLAP, GROUP - OVERLAP):
                yield i, np.array([s, min(s + GROUP, int(at[j]))])
        i = j


def relevant(docs: DataFrame, blocks: list[Items]) -> DataFrame:
    """The passages that a piece of a block can match: block, doc_id, terms, values (rows of A), norm, pieces, context."""
    spark = docs.sparkSession
    all_terms = np.unique(np.concatenate([b.terms for b in blocks]))
    shared = spark.sparkContext.broadcast((all_terms, [b.index(all_terms) for b in blocks]))

    def one(batch):
        all_terms, indexes = shared.value
        data, off = bytes_of(batch.column(1))
        h, _, _, at = words_of(data, off)
        if len(h) == 0:
            return None
        place = np.minimum(np.searchsorted(all_terms, h), len(all_terms) - 1)
        place[all_terms[place] != h] = -1
        out = {"block": [], "doc": [], "norm": [], "terms": [], "values": [], "pieces": [], "context": []}
        for first_doc, bounds in stretches(at):
            a, b = bounds[0], bounds[-1]
            for k, (slot_of, idf, first, pieces, hits, bags, answers) in enumerate(indexes):
                slot = np.where(place[a:b] >= 0, slot_of[place[a:b]], -1)
                known = slot >= 0
                doc, number, piece = reached(slot, known, bounds - a, first, pieces, hits)
                begin = bounds[doc] + np.minimum(number * STEP, np.maximum(0, bounds[doc + 1] - bounds[doc] - PASSAGE))
                begin, end = np.maximum(bounds[doc], begin - MARGIN), np.minimum(bounds[doc + 1], begin + PASSAGE + MARGIN)
                ok = decidable(slot, known, begin - a, end - a, doc * (int(number.max(initial=0)) + 1) + number, piece, len(idf), bags, answers)
                doc, number, piece, begin, end = (x[ok] for x in (doc, number, piece, begin, end))
                if len(doc) == 0:
                    continue
                new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(number) != 0)))
                s, n = begin[new], end[new] - begin[new]
                to = np.concatenate([[0], np.cumsum(n)])
                words_at = np.repeat(s - to[:-1], n) + np.arange(to[-1])
                row, here = np.repeat(np.arange(len(new)), n), slot[words_at - a]
                code, counts = np.unique((row * (len(idf) + 1) + here)[here >= 0], return_counts=True)
                row, where = code // (len(idf) + 1), code % (len(idf) + 1)
                values = counts * idf[where]
                norm = np.maximum(np.sqrt(np.bincount(row, values.astype(np.float64) ** 2, len(new))), 1e-9)
                out["block"].append(np.full(len(new), k, np.int32))
                out["doc"].append(first_doc + doc[new])
                out["norm"].append(norm)
                out["terms"].append((np.bincount(row, minlength=len(new)), where.astype(np.int32)))
                out["values"].append((np.bincount(row, minlength=len(new)), (values / norm[row]).astype(np.float32)))
                out["pieces"].append((np.diff(np.append(new, len(doc))), piece.astype(np.int32)))
                out["context"].append((n, h[words_at].view(np.int64)))
        if not out["doc"]:
            return None
        lists = []
        for name, kind in (("terms", pa.int32()), ("values", pa.float32()), ("pieces", pa.int32()), ("context", pa.int64())):
            cut = np.concatenate([[0], np.cumsum(np.concatenate([n for n, _ in out[name]]))]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([x for _, x in out[name]]), kind)))
        first_three = [pa.array(np.concatenate(out["block"])), batch.column(0).take(pa.array(np.concatenate(out["doc"]))), pa.array(np.concatenate(out["norm"]))]
        return pa.RecordBatch.from_arrays([*first_three, *lists], ["block", "doc_id", "norm", "terms", "values", "pieces", "context"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), one, "block int, doc_id long, norm double, terms array<int>, values array<float>, pieces array<int>, context array<long>")


def dense(off: np.ndarray, terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms that sparse rows hold, and the rows as a matrix over these alone."""
    kinds, at = np.unique(terms, return_inverse=True)
    x = np.zeros((len(off) - 1, len(kinds)), np.float32)
    x[np.repeat(np.arange(len(off) - 1), np.diff(off)), at] = values
    return kinds, x


def images(off: np.ndarray, terms: np.ndarray, values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Products of sparse rows with w."""
    out = np.empty((len(off) - 1, w.shape[1]), w.dtype)
    for k in range(0, len(out), FEW):
        some = off[k : k + FEW + 1]
        kinds, x = dense(some - some[0], terms[some[0] : some[-1]], values[some[0] : some[-1]])
        out[k : k + FEW] = x.astype(w.dtype, copy=False) @ w[kinds]
    return out


def gram(off: np.ndarray, terms: np.ndarray, values: np.ndarray, w: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A w) of sparse rows to total, FEW rows at once: these share most of their terms."""
    for k in range(0, len(off) - 1, FEW):
        some = off[k : k + FEW + 1]
        kinds, x = dense(some - some[0], terms[some[0] : some[-1]], values[some[0] : some[-1]])
        x = x.astype(w.dtype, copy=False)
        total[kinds] += x.T @ (x @ w[kinds])


def _lists(batch, *names):
    columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
    return columns[0].offsets.to_numpy(), [c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in columns]


def gram_times(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """A'(A w) over all rows. Every partition gives a matrix of w's shape, cut into pieces that are added up in a tree of
    SUMS branches, so that no task reads more than about SUMS^2 partial sums before one matrix reaches the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def run(batches):
        w = shared.value
        total = np.zeros(w.shape, np.float64)
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            off, (terms, values) = _lists(b, "terms", "values")
            off = off - off[0]
            if len(terms):
                gram(off[np.append(True, np.diff(off) > 0)], terms, values, w, total)
        give_back()
        here = TaskContext.get().partitionId()
        for k in range(0, len(total), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([here], pa.int64()), pa.array([total[k : k + ROWS].tobytes()], pa.binary())], ["k", "node", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for x in table.column("part"):
            total = total + np.frombuffer(x.as_buffer())
        return pa.table({"k": pa.array([table.column("k")[0].as_py()]), "node": pa.array([table.column("node")[0].as_py()]), "part": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(run, "k long, node long, part binary")
    for _ in range(2):
        sums = sums.withColumn("node", F.floor(F.col("node") / SUMS)).groupBy("k", "node").applyInArrow(add, "k long, node long, part binary")
    out = np.zeros(w.shape)
    for k, _, part in sums.groupBy("k").applyInArrow(add, "k long, node long, part binary").collect():
        out[k : k + ROWS] = np.frombuffer(part).reshape(-1, w.shape[1])
    return out


def latent_space(rows: DataFrame, items: Items) -> np.ndarray:
    """Right singular vectors (terms, rank) of the rows and the items' pieces, by a randomised range finder and a Rayleigh-Ritz step."""
    rows = rows.select("terms", "values")

    def both(w):
        total = gram_times(rows, w)
        gram(items.off, items.slots, items.values, w, total)
        return total

    width = min(RANK + OVER, len(items.terms))
    w = np.random.default_rng(SEED).normal(size=(len(items.terms), width))
    basis = np.linalg.qr(both(w))[0]
    small = basis.T @ both(basis)
    turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :RANK]
    return (basis @ turn).astype(np.float32)


def matches(rows: DataFrame, items: Items, space: np.ndarray) -> DataFrame:
    """doc_id, item_id, cosine, subsequence, answered of the rows that are decided to hold an item's passage."""
    near = images(items.off, items.slots, items.values, space.astype(np.float64))
    left = np.sqrt(np.maximum(0, 1 - (near**2).sum(1)))
    texts = [w.view(np.int64).tolist() for w in items.words]
    shared = rows.sparkSession.sparkContext.broadcast((space, near.astype(np.float32), left, items.least, items.ids, texts, [a.view(np.int64).tolist() for a in items.answers]))

    def one(batch):
        space, near, left, least, ids, texts, answers = shared.value
        off, (terms, values) = _lists(batch, "terms", "values")
        off = off - off[0]
        full = np.flatnonzero(np.diff(off))
        if len(full) == 0:
            return None
        latent = images(off[np.append(full, len(off) - 1)], terms, values, space)
        rest = np.sqrt(np.maximum(0, 1 - (latent**2).sum(1)))
        cut, (piece,) = _lists(batch, "pieces")
        norm = batch.column(batch.schema.get_field_index("norm")).to_numpy()[full]
        r, c = np.repeat(np.arange(len(full)), np.diff(cut)[full]), piece
        product = (latent[r] * near[c]).sum(1)
        cosine = product / np.maximum(np.linalg.norm(latent, axis=1)[r] * np.linalg.norm(near, axis=1)[c], 1e-9)
        may = product + rest[r] * left[c] + SLACK >= least[c] / norm[r]
        r, c, cosine = r[may], c[may], cosine[may]
        docs, (starts, (context,)) = batch.column(0).to_pylist(), _lists(batch, "context")
        starts = starts - starts[0]
        found: dict[tuple, tuple] = {}
        contexts: dict[int, list] = {}
        places = {j: places_of(texts[j]) for j in set(c.tolist())}
        for i, j, near_by in zip(r.tolist(), c.tolist(), cosine.tolist(), strict=True):
            row = int(full[i])
            if row not in contexts:
                contexts[row] = context[starts[row] : starts[row + 1]].tolist()
            here, text = contexts[row], texts[j]
            if len(text) < SHORT:
                if any(here[k : k + len(text)] == text for k in range(len(here))):
                    found[docs[row], ids[j]] = (1.0, near_by, True)
                continue
            share = common_subsequence(text, here, places[j]) / len(text)
            if share < LOOSE:
                continue
            answered = common_subsequence(answers[j], here) >= ANSWERED * len(answers[j])
            if share >= CLEAR or answered:
                key, got = (docs[row], ids[j]), (share, near_by, answered)
                found[key] = max(found.get(key, got), got)
        if not found:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), *[pa.array([v[n] for v in found.values()]) for n in (1, 0, 2)]], ["doc_id", "item_id", "cosine", "subsequence", "answered"]
        )

    return map_arrow(rows, one, "doc_id long, item_id long, cosine double, subsequence double, answered boolean", ROWS)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, subsequence, answered: one row for each document and item that it holds a passage of.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored, whatever their names. Words are runs of
    letters and digits (any character beyond ASCII counts as one), A-Z and Latin-1 capitals as small letters. Null and
    empty texts hold nothing, null and wordless items are held by nothing; items of under SHORT words are sought as
    phrases. Rows with a null doc_id are left aside, as nothing could name them; rows with equal doc_id are one document,
    repeated rows and items count once. Texts are read whole. Empty tables give an empty result. The benchmark goes to
    the driver (it is held to be far smaller than the documents) and from there in blocks of PIECES pieces; SCAN blocks
    share one reading of the documents. What is found of an item does not depend on the other items.
    """
    docs = require(docs, "doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    items = [(r["item_id"], r["text"]) for r in require(benchmark, "item_id", "text").where("text is not null and item_id is not null").orderBy("item_id", "text").collect()]
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, subsequence double, answered boolean")
    if not items:
        return found
    idf = weights(frequencies(docs))
    parts = []
    pieces = pieces_of(items)
    blocks = [Items(pieces[k : k + PIECES], idf) for k in range(0, len(pieces), PIECES)]
    for k in range(0, len(blocks), SCAN):
        some = blocks[k : k + SCAN]
        rows = save(relevant(docs, some), *(["block"] if len(some) > 1 else []))
        for i, block in enumerate(some):
            own = rows.where(F.col("block") == i).drop("block")
            parts.append(save(matches(own, block, latent_space(own, block))))
        forget(rows)
    for p in parts:
        found = found.unionByName(p)
    best = F.max(F.struct("subsequence", "cosine", "answered")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.subsequence", "b.answered")


def without(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark passage; their columns stay as they are, whatever their names.

    All rows of a doc_id go if one of them holds a passage; rows with a null doc_id, null and empty texts stay. An empty
    table or benchmark leaves docs as they are.
    """
    return without_ids(docs, contaminated(docs, benchmark).select("doc_id"))
