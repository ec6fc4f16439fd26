"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

A document is described by about twenty numbers (lengths, shares of kinds of characters, words and lines, repetition), taken
from its bytes without regard to language; shares are put on a log scale, so that the classes are nearer to normal. Of each class the
mean and covariance are sums over all labelled rows, gathered by task. A covariance is shrunk towards that of both classes together, the
more the fewer rows it has, and then towards a multiple of the identity. The score follows from the difference of the two
log densities, whose Mahalanobis lengths come from the inverse Cholesky factors that the model keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import SPACE, arrow_lists, bytes_of, free_name, lists, map_arrow, mix, require, save, shingle_hashes, tune, words
from pairwright.llm.language_id import held_out

#: How far a covariance is drawn to a multiple of the identity, and the share that counts as none on the log scale.
RIDGE, NONE = 0.02, 0.01
#: Score from which a document counts as of label 1.
THRESHOLD = 0.3

STATISTICS = (
    "chars", "words", "upper", "digits", "marks", "stops", "commas", "capital_words", "mark_words", "marked_ends", "title_words",
    "word_length", "word_spread", "word_longest", "distinct", "repeated_runs", "top_word", "repeated_lines", "words_a_line", "top_pair",
)


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("abcdefghijklmnopqrstuvwxyz"), _kind("0123456789")
_BEYOND = np.arange(256) >= 128
_LEAD = (np.arange(256) & 0xC0) != 0x80
_MARK = ~(_UPPER | _LOWER | _DIGIT | _BEYOND | SPACE)
_STOP, _COMMA, _ENDING = _kind(".!?"), _kind(","), _kind(".,;:?\"')")
_NOT_BREAK = np.arange(256) != 10
_FIRST = np.arange(256) == 10


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _kinds(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, greatest count of one) of each text; the values of text i are hashes[at[i]:at[i + 1]]."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    _, first, count = np.unique(mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[first], count)
    return np.bincount(owner[first], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, len(STATISTICS)) numbers of the texts whose bytes are data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1

    def count(table: np.ndarray) -> np.ndarray:
        return np.diff(_sums(table[data])[offsets])

    hashes, start, end, at = words(data, offsets)
    n_words = np.diff(at)
    lead = _sums(_LEAD[data])
    width = lead[end] - lead[start]

    def by_word(flags: np.ndarray) -> np.ndarray:
        return np.diff(_sums(flags)[at])

    upper, lower, marks = _sums(_UPPER[data]), _sums(_LOWER[data]), _sums(_MARK[data])
    capital = (upper[end] - upper[start] >= 2) & (lower[end] == lower[start])
    marked = marks[end] - marks[start] == end - start
    total, square = by_word(width), by_word(width * width)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, np.repeat(np.arange(n), n_words), width)
    distinct, top = _kinds(hashes, at)
    runs, run_at = shingle_hashes(data, offsets, 3)
    pairs, pair_at = shingle_hashes(data, offsets, 2)
    lines, _, _, line_at = words(data, offsets, _FIRST)  # a line that is not empty is what lies between line breaks
    n_lines = np.diff(line_at)

    chars = np.diff(lead[offsets])
    some, some_words, some_lines = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    mean = total / some_words

    def share(x):
        return np.log(x + NONE)

    out = [
        np.log1p(chars), np.log1p(n_words), share(count(_UPPER) / np.maximum(count(_UPPER | _LOWER), 1)), share(count(_DIGIT) / some), share(count(_MARK) / some),
        share(count(_STOP) / some_words), share(count(_COMMA) / some_words), share(by_word(capital) / some_words), share(by_word(marked) / some_words),
        share(by_word(_MARK[data[end - 1]] & ~_ENDING[data[end - 1]] if len(end) else np.zeros(0, bool)) / some_words),
        share(by_word(_UPPER[data[start]] if len(start) else np.zeros(0, bool)) / some_words),
        np.log1p(mean), np.sqrt(np.maximum(square / some_words - mean * mean, 0)), np.log1p(longest), share(distinct / some_words**0.9),
        share(1 - _kinds(runs, run_at)[0] / np.maximum(np.diff(run_at), 1)), share(top / some_words), share(1 - _kinds(lines, line_at)[0] / some_lines),
        np.log1p(n_words / some_lines), share(_kinds(pairs, pair_at)[1] / some_words),
    ]
    return np.stack(out, axis=1).astype(np.float64)


@dataclass
class Discriminant:
    """centre and scale of the numbers; by class (0, 1) the mean, the inverse Cholesky factor and the log of its determinant and prior."""

    centre: np.ndarray
    scale: np.ndarray
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    constant: list[float]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with priors."""
        z = (x - self.centre) / self.scale
        both = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.mean, self.factor, self.constant, strict=True)]
        return both[1] - both[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Near its middle the probability of label 1. Differences far from 0 are drawn in (asinh), as normal tails are too sure, but never equal."""
        return 1 / (1 + np.exp(-np.arcsinh(self.difference(x))))


def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], ridge: float = RIDGE) -> Discriminant | None:
    """From (rows, sum of x, sum of x x') of each class; None without rows of both."""
    if any(sums.get(k, (0,))[0] == 0 for k in (0, 1)):
        return None
    n = {k: sums[k][0] for k in (0, 1)}
    every = n[0] + n[1]
    centre = (sums[0][1] + sums[1][1]) / every
    d = len(centre)
    scale = np.sqrt(np.maximum(np.diag(sums[0][2] + sums[1][2]) / every - centre**2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)  # a number that is the same everywhere says nothing
    own, means = {}, {}
    for k in (0, 1):
        m = sums[k][1] / n[k]
        own[k] = (sums[k][2] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
        means[k] = (m - centre) / scale
    pooled = (n[0] * own[0] + n[1] * own[1]) / every
    factors, constants = [], []
    for k in (0, 1):
        few = d / (d + n[k])
        c = (1 - few) * own[k] + few * pooled
        c = (1 - ridge) * c + ridge * max(np.trace(c) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky((c + c.T) / 2)
        factors.append(np.linalg.inv(low))
        constants.append(float(np.log(n[k] / every) - np.log(np.diag(low)).sum()))
    return Discriminant(centre, scale, [means[0], means[1]], factors, constants)


def described(docs: DataFrame, keep: list[str], name: str = "numbers") -> DataFrame:
    """The columns `keep` of docs and, as `name`, the statistics of the text."""
    source = free_name(docs.select(*[F.col(f"`{c}`") for c in keep]), "text")
    wanted = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias(source))

    def one(batch):
        x = statistics(*bytes_of(batch.column(len(keep))))
        numbers = arrow_lists(x.ravel(), np.arange(len(x) + 1) * len(STATISTICS))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], numbers], [*keep, name])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wanted.schema.fields[:-1])
    return map_arrow(wanted, one, f"{fields}{name} array<double>")


def class_sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(rows, sum, sum of products) of `numbers` by `label`, over all rows; a task sends one row a class."""
    d = len(STATISTICS)
    tune(rows.sparkSession)

    def run(batches):
        n, total = np.zeros(2, np.int64), np.zeros((2, d + d * d))
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = lists(batch.column(1))[0].reshape(-1, d)
            for k in (0, 1):
                own = x[label == k]
                n[k] += len(own)
                total[k] += np.concatenate([own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(n), arrow_lists(total.ravel(), np.arange(3) * total.shape[1])], ["label", "n", "total"])

    parts = rows.select("label", "numbers").mapInArrow(run, "label long, n long, total array<double>")
    # sums by place in the vector; (d + d * d) rows a class come to the driver
    flat = parts.select("label", "n", F.posexplode("total").alias("place", "value"))
    out = {}
    for r in flat.groupBy("label", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
        out.setdefault(r["label"], [0, np.zeros(d + d * d)])
        out[r["label"]][0] = r["n"]
        out[r["label"]][1][r["place"]] = r["value"]
    return {k: (n, v[:d], v[d:].reshape(d, d)) for k, (n, v) in out.items()}


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` (doc_id unless given), held_out, score and predicted of every row of docs.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad; all else and nulls are no labels). Learns from all labelled rows
    whose doc_id is not held out; a label counts once for each document row of its doc_id, repeated and contradictory ones count each. Only the text
    is an input of a score. Null and empty texts have the statistics of an empty text and are scored by them. Very long texts are
    read whole. Without rows of both labels to learn from, the score is the share of label 1 among them, or 0.5 without any. Columns
    held_out, score and predicted of docs are replaced; other columns pass only if named in keep. Repeated rows score alike; an empty docs gives an empty result.
    """
    keep = [c for c in (keep or ["doc_id"]) if c not in ("held_out", "score", "predicted")]
    base = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "doc_id", "text"])])
    out_of, numbers = free_name(base, "held"), free_name(base, "numbers")
    rows = save(described(base.withColumn(out_of, held_out(F.col("doc_id"))), [*dict.fromkeys([*keep, "doc_id"]), out_of], numbers))
    known = require(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1)).where(~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("long").alias("label"))
    sums = class_sums(rows.select("doc_id", F.col(numbers).alias("numbers")).join(known, F.col("doc_id") == F.col("labelled")))
    model = fit(sums)
    n = {k: sums.get(k, (0,))[0] for k in (0, 1)}
    flat = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few kB

    def one(batch):
        m, x = shared.value, lists(batch.column(batch.num_columns - 1))[0].reshape(-1, len(STATISTICS))
        p = m.score(x) if m else np.full(len(x), flat)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    wanted = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(out_of).alias("held_out"), numbers)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wanted.schema.fields[:-1])
    return map_arrow(wanted, one, f"{fields}score double, predicted int")


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all their columns but held_out, score and predicted, that score threshold or more."""
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return score(docs, labels, names, threshold).where("predicted = 1").select(*[F.col(f"`{c}`") for c in names])
