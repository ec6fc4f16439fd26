"""Language ID by prediction by partial matching.

For each language a tree of byte contexts of 0 to ORDER bytes counts which byte follows. A byte costs -log2 of its
probability in the longest context seen; a byte new to a context escapes to the context one shorter with the escape
probability of method C (distinct / (total + distinct)), down to a uniform order -1. Counts are frozen after training,
so the cost of a byte after a context is fixed: the trees are kept as hash tables of all byte strings of up to ORDER + 1
bytes that any language has seen, with the cost in each language, and of the contexts' escape costs. A byte is looked up
with its longest context first, and again with a shorter one only if no language has seen it there. The language with
the shortest code wins; score is its share of the likelihood.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import bytes_of, free_name, map_arrow

ORDER = 3
#: Training sample: documents a language (about; the ones with the smallest hash of doc_id) and their bytes at most.
SAMPLE_DOCS, SAMPLE_BYTES = 240, 600_000
UNKNOWN = "und"
_LATIN = re.compile(rb"[A-Za-z]")
#: Bytes that are scored at once.
PIECE = 1 << 18


def _fold(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Table:
    """Rows of float32 by 32-bit keys; a key that is not there has row -1. Open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint32(32 - max(4, (4 * len(keys)).bit_length()))
        self.rows = np.full(1 << (32 - int(self.shift)), -1, np.int32)
        self.keys, self.values = keys.astype(np.uint32), values.astype(np.float32)
        left, place = np.arange(len(keys)), self._home(self.keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.rows[place] < 0
            self.rows[place[free]] = left[free]
            out = self.rows[place] != left
            left, place = left[out], (place[out] + 1) & (len(self.rows) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = self._home(keys)
        row = self.rows[place]
        if len(self.keys) == 0:
            return row
        wrong = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        for _ in range(1, self.probes):
            if len(wrong) == 0:
                break
            place[wrong] = (place[wrong] + 1) & (len(self.rows) - 1)
            row[wrong] = self.rows[place[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.keys[row[wrong]] != keys[wrong])]
        row[wrong] = -1
        return row


class Model:
    """langs; by order, tables of the costs of a byte after a context (key: their bytes) and of a context's escape."""

    def __init__(self, langs: list[str], cost: list[Table], escape: list[Table]):
        self.langs, self.cost, self.escape = langs, cost, escape

    def bits(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Cost in each language of the last byte of each gram after the `order` bytes before it."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        row = self.cost[order].find(grams)
        out = self.cost[order].values[row] if len(self.cost[order].values) else np.zeros((len(grams), len(self.langs)), np.float32)
        none = np.flatnonzero(row < 0)
        if len(none):
            rest = grams[none]
            out[none] = self.bits(rest & np.uint32((1 << 8 * order) - 1), order - 1)
            context = self.escape[order].find(rest >> np.uint32(8))
            seen = np.flatnonzero(context >= 0)
            out[none[seen]] += self.escape[order].values[context[seen]]
        return out


def context_tree(text: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """By order: grams (context and next byte as one number, ascending), counts, and contexts with total and distinct followers."""
    levels = []
    for order in range(ORDER + 1):
        gram = np.zeros(max(len(text) - order, 0), np.uint32)
        for k in range(order + 1):
            gram = (gram << np.uint32(8)) | text[k : len(text) - order + k]
        grams, counts = np.unique(gram, return_counts=True)
        contexts, first = np.unique(grams >> np.uint32(8), return_index=True)
        total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
        levels.append((grams, counts, contexts, total, np.diff(np.append(first, len(grams)))))
    return levels


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of keys are among sorted_keys, and where)."""
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def train(samples: dict[str, list[bytes]]) -> Model:
    langs = sorted(samples)
    trees = [context_tree(_fold(np.frombuffer(b"\n".join(samples[k])[:SAMPLE_BYTES], np.uint8))) for k in langs]
    model = Model(langs, [], [])
    for order in range(ORDER + 1):
        grams = np.unique(np.concatenate([t[order][0] for t in trees] or [np.zeros(0, np.uint32)]))
        contexts = np.unique(np.concatenate([t[order][2] for t in trees] or [np.zeros(0, np.uint32)]))
        cost = model.bits(grams & np.uint32((1 << 8 * order) - 1), order - 1).astype(np.float64)
        escape = np.zeros((len(contexts), len(langs)))
        for i, t in enumerate(trees):
            own, counts, own_contexts, total, kinds = t[order]
            has, at = _at(own_contexts, contexts)
            escape[has, i] = np.log2((total + kinds) / np.maximum(kinds, 1))[at[has]]
            of = np.searchsorted(contexts, grams >> np.uint32(8))
            cost[:, i] += escape[of, i]
            has, at = _at(own, grams)
            mine = np.searchsorted(own_contexts, grams[has] >> np.uint32(8))
            cost[has, i] = np.log2((total + kinds)[mine] / counts[at[has]])
        model.cost.append(Table(grams, cost))
        model.escape.append(Table(contexts, escape))
    return model


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language, (texts, languages). A text starts after ORDER line breaks."""
    bits = np.zeros((len(offsets) - 1, len(model.langs)))
    for at in range(0, len(data), PIECE):
        to = min(at + PIECE, len(data))
        lead = min(at, ORDER)
        s = np.concatenate([np.full(ORDER - lead, 10, np.uint8), _fold(data[at - lead : to])])
        gram = np.zeros(to - at, np.uint32)
        for k in range(ORDER + 1):
            gram = (gram << np.uint32(8)) | s[k : k + to - at]
        i, j = np.searchsorted(offsets, [at, to], "right") - 1
        # the first bytes of a text come after line breaks, not after the text before it
        begin = np.unique(offsets[i : j + 1])
        for k in range(ORDER):
            here = begin + k
            here = here[(here >= at) & (here < to)]
            if k:  # not beyond the next text's start
                here = here[np.searchsorted(begin, here, "right") == np.searchsorted(begin, here - k, "right")]
            own = np.uint32((1 << 8 * (k + 1)) - 1)
            gram[here - at] = (gram[here - at] & own) | (np.uint32(0x0A0A0A0A) & ~own)
        cost = model.bits(gram)
        cuts = offsets[i : j + 1] - at
        cuts[0] = max(cuts[0], 0)
        rows = np.arange(i, j + 1)
        full = np.flatnonzero(np.diff(np.append(cuts, to - at)) > 0)  # reduceat needs starts of texts that have bytes here
        bits[rows[full]] += np.add.reduceat(cost, cuts[full], axis=0, dtype=np.float64)
    return bits


def has_letter(text: bytes) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS) -> dict[str, list[bytes]]:
    """Texts to learn from by lang: of the rows with lang and a text of SAMPLE_BYTES at most, those whose hashed doc_id is
    small enough to leave about docs_each."""
    usable = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    pick = F.lit(False)
    for lang, n in counts.items():
        pick = pick | ((F.col("lang") == lang) & (place < int((1 << 40) * min(1.0, 1.25 * docs_each / n))))
    out: dict[str, list[bytes]] = defaultdict(list)
    if counts:
        rows = usable.where(pick).select("lang", place.alias("place"), F.col("text").cast("binary").alias("text"))
        for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["place"], bytes(r["text"]))):
            if len(out[r["lang"]]) < docs_each:
                out[r["lang"]].append(bytes(r["text"]))
    return out


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` (doc_id among them, or any) with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # about 30 bytes and 4 more a language for each gram of the samples
    source = "text" if "text" in keep else free_name(docs.select(*[F.col(f"`{c}`") for c in keep]), "text")

    def one(batch):
        m = shared.value
        data, at = bytes_of(batch.column(batch.schema.get_field_index(source)))
        bits = code_lengths(m, data, at) if m.langs else np.zeros((batch.num_rows, 0))
        lang, score = [], []
        for i in range(batch.num_rows):
            if not m.langs or not has_letter(data[at[i] : at[i + 1]].tobytes()):
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            best = int(np.argmin(bits[i]))
            lang.append(m.langs[best])
            score.append(float(1 / np.exp2(np.clip(bits[i][best] - bits[i], -1000, 0)).sum()))
        columns = [batch.column(batch.schema.get_field_index(n)) for n in keep]
        return pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    wanted = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if source in keep else [F.col("text").cast("binary").alias(source)]))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wanted.schema.fields if f.name in keep)
    return map_arrow(wanted, one, f"{fields}lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5, is 0; a null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row: `keep`, held_out, lang_pred, score.

    docs: doc_id, text, lang. A text that is null or has no letter is 'und' with score 0, and so is every text if
    there is nothing to learn from. Equal costs go to the first language by name. lang, source and doc_id are no
    inputs of a prediction. Very long texts are read whole. Extra columns pass only if named in keep; columns
    held_out, lang_pred and score of docs are replaced. Repeated rows are predicted each. An empty table gives an empty
    result. The trees learn from a sample of the labelled rows: about SAMPLE_DOCS documents a language, none longer than
    SAMPLE_BYTES, and of all of them together SAMPLE_BYTES.
    """
    keep = [c for c in keep if c not in ("held_out", "lang_pred", "score")]
    model = train(sample(docs.where(~held_out(F.col("doc_id")))))
    base = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])], held_out(F.col("doc_id")).alias("held_out"))
    return predict(base, model, [*keep, "held_out"])


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the documents that have no letters or no language with at least that score.

    Columns stay as they are, whatever their names, but held_out, lang_pred and score, which are dropped. Null, empty and
    letterless texts go; repeated rows stay or go together; of an empty table nothing is left.
    """
    names = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    return identify(docs, names).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"`{c}`") for c in names])
