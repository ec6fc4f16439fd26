"""Set similarities of titles (T10-T13, G4) as Column functions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.text import let


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """T12 on token sets; 0 if either is empty."""
    both = shared(a, b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both).cast("double")).otherwise(0.0)


def blend(a: Column, b: Column) -> Column:
    """Half Jaccard, half containment in the smaller set."""
    score = lambda both: F.lit(0.5) * (both / (F.size(a) + F.size(b) - both).cast("double")) + F.lit(0.5) * (both / F.least(F.size(a), F.size(b)).cast("double"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), let(shared(a, b), lambda both: F.least(F.lit(1.0), score(both)))).otherwise(0.0)


def long_numbers(title: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"(\d{3,})"), 1)


def blend_with_numbers(a: Column, b: Column, numbers_a: Column, numbers_b: Column) -> Column:
    """The blend, and 0.08 for each number of three digits or more of a that b has too, 1 at most."""
    same = F.size(F.filter(numbers_a, lambda n: F.array_contains(numbers_b, n)))
    lifted = lambda score, n: F.when((F.size(a) > 0) & (F.size(b) > 0) & (n > 0), F.least(F.lit(1.0), score + F.lit(0.08) * n)).otherwise(score)
    return let(F.struct(blend(a, b).alias("score"), same.alias("n")), lambda x: lifted(x["score"], x["n"]))


def weighted_mean(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean by weight over the signals that are not null; 0 if none is."""
    top = sum((F.coalesce(F.lit(w) * signals[k], F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    base = sum((F.when(signals[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.when(base > 0, top / base).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """A provider over embeddings in place of token similarity; null if either vector is zero or missing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    base = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(base > 0, dot(a, b) / base)
