"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2 t) of each other, and so do their projections. Vectors are
projected on the leading principal axes (of all vectors), gridded with cell width eps and sorted by label and grid
cell. The sequence is cut into runs of rows; a run keeps the bounding box of its projections. Runs whose boxes are
farther apart than eps are never paired; a pair of runs is split recursively, skipping distant parts, down to blocks
that are multiplied out in double precision.

Equal vectors of a label form one class and take part once. A pair of runs sends back, for each class, how many vectors
it is linked with and a spanning forest of the links, never the pairs themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import connected_components, map_arrow, save, tune

AXES = 4
#: Rows of a run; pairs of runs are the unit of work and a run is sent once for each partner.
RUN = 1024
#: Rows below which the recursion multiplies out.
LEAF = 64
#: Cosines this close to the threshold are summed again exactly.
NEAR = 1e-9


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64), off


def can_link() -> F.Column:
    """vec_id, label and vector are there, all components finite, not all zero."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = v.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def axes_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by dimension of the vectors, (AXES, dim), of all classes. Any orthonormal axes give right results."""

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            values, off = _matrix(b.column(0))
            dims = np.diff(off)
            for d in np.unique(dims).tolist():
                x = np.stack([values[off[i] : off[i + 1]] for i in np.flatnonzero(dims == d)])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                x = np.hstack([x, np.ones((len(x), 1))])
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], ["dim", "i", "j", "v"])

    sums = classes.select("embedding").mapInArrow(moments, "dim long, i long, j long, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    by: dict[int, list] = {}
    for d, i, j, v in sums.collect():  # (dim + 1) squared rows
        by.setdefault(d, []).append((i, j, v))
    out = {}
    for d, cells in by.items():
        m = np.zeros((d + 1, d + 1))
        for i, j, v in cells:
            m[i, j] = v
        n = m[d, d]
        mean = m[d, :d] / n
        out[d] = np.linalg.eigh(m[:d, :d] / n - np.outer(mean, mean))[1][:, ::-1][:, :AXES].T.copy()
    return out


class Run:
    """Rows of one label in grid order: unit vectors, raw vectors, projections, ids, how many vectors each stands for."""

    def __init__(self, ids, weight, raw, axes):
        self.ids, self.weight, self.raw = ids, weight, raw
        self.norm = np.linalg.norm(raw, axis=1)
        self.unit = raw / self.norm[:, None]
        self.low_dim = self.unit @ axes.T


def apart(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the bounding boxes of two sets of projections are farther apart than eps."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > eps * eps + 1e-9


def ego_join(a: Run, b: Run, cosine: float, eps: float):
    """Yields (rows of a, rows of b) that link; with a is b each pair once."""
    same = a is b
    todo = [(0, len(a.ids), 0, len(b.ids))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1 or (same and a0 >= b1) or apart(a.low_dim[a0:a1], b.low_dim[b0:b1], eps):
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            am, bm = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2
            a_parts = ((a0, am), (am, a1)) if a1 - a0 > LEAF else ((a0, a1),)
            b_parts = ((b0, bm), (bm, b1)) if b1 - b0 > LEAF else ((b0, b1),)
            todo += [(x0, x1, y0, y1) for x0, x1 in a_parts for y0, y1 in b_parts if not (same and x0 > y0)]
            continue
        dots = a.unit[a0:a1] @ b.unit[b0:b1].T
        hit = dots >= cosine
        for i, j in zip(*np.nonzero(np.abs(dots - cosine) <= NEAR), strict=True):
            x, y = a.raw[a0 + i], b.raw[b0 + j]
            hit[i, j] = math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))) >= cosine
        i, j = np.nonzero(hit)
        i, j = i + a0, j + b0
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def forest(pairs: np.ndarray, n: int) -> list[int]:
    """Indices of pairs that make a spanning forest of the nodes 0 .. n-1."""
    parent, out = list(range(n)), []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (i, j) in enumerate(pairs.tolist()):
        i, j = find(i), find(j)
        if i != j:
            parent[i] = j
            out.append(k)
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors are compared only with equal labels and lengths. A null label or vector, a null or non-finite component or
    a zero vector links with nothing: n_links 0, its own component, kept. So does a null vec_id (component null,
    kept null). Equal vectors link (a row that is repeated counts as another vector). Other columns are ignored. An
    empty table gives an empty result. cosine must be above 0.
    """
    eps = math.sqrt(2 - 2 * cosine)
    vectors = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).withColumn("vec_id", F.col("vec_id").cast("long"))
    digest = [F.xxhash64("dim", "embedding"), F.xxhash64(F.lit(1), "embedding", "dim")]
    rows = vectors.where(can_link()).withColumn("dim", F.size("embedding")).withColumn("d1", digest[0]).withColumn("d2", digest[1])
    classes = rows.groupBy("label", "d1", "d2").agg(F.min(F.struct("vec_id", "embedding")).alias("r"), F.count("*").alias("weight"))
    classes = save(classes.select("label", "d1", "d2", F.col("r.vec_id").alias("id"), F.col("r.embedding").alias("embedding"), "weight"))
    axes = axes_of(classes)

    def cells(batch):
        values, off = _matrix(batch.column(batch.schema.get_field_index("embedding")))
        grid = np.zeros((batch.num_rows, AXES), np.int64)
        for i in range(batch.num_rows):
            x = values[off[i] : off[i + 1]]
            p = axes[len(x)] @ (x / np.linalg.norm(x))
            grid[i, : len(p)] = np.floor(p / eps)
        out = [batch.column(batch.schema.get_field_index(c)) for c in ("label", "id", "weight", "embedding")]
        return pa.RecordBatch.from_arrays([*out, pa.array(np.diff(off)), *[pa.array(grid[:, k]) for k in range(AXES)]], ["label", "id", "weight", "embedding", "dim", *[f"c{k}" for k in range(AXES)]])

    label = classes.schema["label"].dataType.simpleString()
    fields = ", ".join(f"c{k} long" for k in range(AXES))
    order = ["label", "dim", *[f"c{k}" for k in range(AXES)], "id"]
    placed = map_arrow(classes.select("label", "id", "weight", "embedding"), cells, f"label {label}, id long, weight long, embedding array<double>, dim long, {fields}")
    placed = save(placed)
    count = placed.count()
    sequence = placed.repartitionByRange(max(1, min(10_000, -(-count // (2 * RUN)))), *order).sortWithinPartitions(*order)

    def runs(batches):
        """Runs of consecutive rows of one label and dimension, each a row with its bounding box."""
        held: list[tuple] = []

        def flush():
            ids = np.array([h[2] for h in held], np.int64)
            raw = np.array([h[4] for h in held])
            run = Run(ids, np.array([h[3] for h in held], np.int64), raw, axes[raw.shape[1]])
            low, high = run.low_dim.min(0), run.low_dim.max(0)
            return {
                "label": held[0][0], "dim": held[0][1], "run": int(ids.min()), "low": low.tolist(), "high": high.tolist(),
                "ids": ids.tobytes(), "weights": run.weight.tobytes(), "raw": raw.tobytes(),
            }

        for b in batches:
            t = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("label", "dim", "id", "weight", "embedding")]
            for row in zip(*t, strict=True):
                if held and (len(held) == RUN or held[0][:2] != row[:2]):
                    yield pa.RecordBatch.from_pylist([flush()], schema)
                    held.clear()
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([flush()], schema)

    arrow_label = classes.limit(0).select("label").toArrow().schema.field(0).type
    schema = pa.schema([("label", arrow_label), ("dim", pa.int64()), ("run", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("weights", pa.binary()), ("raw", pa.binary())])
    cut = save(sequence.mapInArrow(runs, f"label {label}, dim long, run long, low array<double>, high array<double>, ids binary, weights binary, raw binary"))
    # runs whose boxes are within eps: they share a cell of the leading axis, once widened by eps; taken at the first such cell
    box = cut.select("label", "dim", "run", "low", "high")
    first, last = F.floor((F.element_at("low", 1) - eps / 2 - 1e-9) / eps).cast("long"), F.floor((F.element_at("high", 1) + eps / 2 + 1e-9) / eps).cast("long")
    spread = box.withColumn("first", first).withColumn("cell", F.explode(F.sequence(first, last)))
    a = spread.select("label", "dim", "cell", *[F.col(c).alias(f"a_{c}") for c in ("run", "low", "high", "first")])
    b = spread.select("label", "dim", "cell", *[F.col(c).alias(f"b_{c}") for c in ("run", "low", "high", "first")])
    gap = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: F.greatest(F.lit(0.0), x - y))
    squared = F.aggregate(F.zip_with(gap("a_low", "b_high"), gap("b_low", "a_high"), lambda x, y: F.pow(F.greatest(x, y), 2)), F.lit(0.0), lambda s, x: s + x)
    near = a.join(b, ["label", "dim", "cell"]).where("a_run <= b_run").where(F.col("cell") == F.greatest("a_first", "b_first")).where(squared <= eps * eps + 1e-9)
    near = near.select(F.col("a_run").alias("x"), F.col("b_run").alias("y"))
    payload = cut.select("run", "dim", "ids", "weights", "raw")
    work = near.join(payload.select(F.col("run").alias("x"), "dim", *[F.col(c).alias(f"a_{c}") for c in ("ids", "weights", "raw")]), "x")
    # a pair of a run with itself carries it once
    other = payload.select(F.col("run").alias("y"), *[F.col(c).alias(f"b_{c}") for c in ("ids", "weights", "raw")])
    work = work.join(other, "y").select("x", "y", "dim", "a_ids", "a_weights", "a_raw", "b_ids", "b_weights", "b_raw")

    def search(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                load = lambda s: Run(np.frombuffer(r[f"{s}_ids"], np.int64), np.frombuffer(r[f"{s}_weights"], np.int64), np.frombuffer(r[f"{s}_raw"]).reshape(-1, r["dim"]), axes[r["dim"]])  # noqa: B023, E731
                p = load("a")
                q = p if r["x"] == r["y"] else load("b")
                na = len(p.ids)
                links_p = np.zeros(na, np.int64)
                links_q = links_p if q is p else np.zeros(len(q.ids), np.int64)
                tree = []
                for i, j in ego_join(p, q, cosine, eps):
                    np.add.at(links_p, i, q.weight[j])
                    np.add.at(links_q, j, p.weight[i])
                    tree.append(np.stack([i, j if q is p else j + na], 1))
                    if sum(map(len, tree)) > 200_000:
                        every = np.concatenate(tree)
                        tree = [every[forest(every, na + len(q.ids))]]
                ids = p.ids if q is p else np.concatenate([p.ids, q.ids])
                links = links_p if q is p else np.concatenate([links_p, links_q])
                some = np.flatnonzero(links)
                every = np.concatenate(tree) if tree else np.zeros((0, 2), np.int64)
                every = ids[every[forest(every, len(ids))]]
                n, m = len(some), len(every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[some], every[:, 0]])), pa.array(np.concatenate([links[some], np.zeros(m, np.int64)])), pa.array([None] * n + every[:, 1].tolist(), pa.int64())],
                    ["id", "links", "other"],
                )

    tune(vectors.sparkSession)  # batches end by bytes; a pair of runs is about a batch
    found = save(work.mapInArrow(search, "id long, links long, other long"))
    comp = connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(links, "id", "left").join(comp, "id", "left").select("label", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    every = rows.select("vec_id", "label", "d1", "d2").join(known, ["label", "d1", "d2"], "left").select("vec_id", "n_links", "component_id")
    rest = vectors.where(~can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return every.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
