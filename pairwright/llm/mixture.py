"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). Patterns supply tokens, once
at no cost and again at a rising cost for each repetition; sources ask for their target. The flow between them is
found on this small graph; then documents are chosen in a seeded order until each pattern has given what it is to give.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import WORD, free_name, save

#: Hex digits of a document's place in the order that make its bin; running sums are taken over bins first.
DIGITS = 3
#: Rows of the source table up to which it is broadcast.
MOST_SOURCES = 10_000


def water_filled(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0, total: float | None = None) -> list[float]:
    """Targets of share x total (all sizes, unless given) by weight; none is above most x its size, and what that leaves is dealt again by weight."""
    out, rest = [0.0] * len(sizes), share * (sum(sizes) if total is None else total)
    # the sources that fill up first have the least room for their weight
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    weight = float(sum(weights))
    for k, i in enumerate(order):
        if rest * weights[i] / weight <= most * sizes[i]:
            for j in order[k:]:
                out[j] = rest * weights[j] / weight
            break
        out[i] = float(most * sizes[i])
        rest -= out[i]
        weight -= weights[i]
    return out


def together(allowed: Sequence[Sequence[int]], n: int) -> list[tuple[list[int], list[int]]]:
    """Patterns and sources (of 0 .. n - 1) that hang together by the patterns' sources."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for own in allowed:
        for s in own[1:]:
            parent[find(s)] = find(own[0])
    groups: dict[int, tuple[list[int], list[int]]] = {}
    for s in range(n):
        groups.setdefault(find(s), ([], []))[1].append(s)
    for p, own in enumerate(allowed):
        if own:
            groups[find(own[0])][0].append(p)
    return list(groups.values())


def routed(supply: Sequence[int], demand: Sequence[int], allowed: Sequence[Sequence[int]], repeats: int = 2) -> list[dict[int, int]]:
    """min_cost_flow, solved for each group of sources that share patterns."""
    out: list[dict[int, int]] = [{} for _ in supply]
    for patterns, sources in together(allowed, len(demand)):
        place = {s: k for k, s in enumerate(sources)}
        flows = min_cost_flow([supply[p] for p in patterns], [demand[s] for s in sources], [[place[s] for s in allowed[p]] for p in patterns], repeats)
        for p, f in zip(patterns, flows, strict=True):
            out[p] = {sources[k]: v for k, v in f.items()}
    return out


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], allowed: Sequence[Sequence[int]], repeats: int = 2) -> list[dict[int, int]]:
    """flow[pattern][source] in tokens: as much of demand as can be met, at the least cost.

    Pattern p gives supply[p] tokens at cost 0, as many again at cost 1, and so on up to `repeats` times (a convex
    cost), to the sources in allowed[p]. Successive shortest paths with potentials; integers throughout.
    """
    n_p, n_s = len(supply), len(demand)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[list]] = [[] for _ in range(end + 1)]  # [to, capacity, cost, index of the reverse arc]

    def arc(u, v, capacity, cost):
        graph[u].append([v, capacity, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for p in range(n_p):
        for k in range(repeats):
            arc(start, p, supply[p], k)
        for s in allowed[p]:
            arc(p, n_p + s, supply[p] * repeats, 0)
    for s in range(n_s):
        arc(n_p + s, end, demand[s], 0)
    potential = [0] * (end + 1)
    while True:
        dist, via = [None] * (end + 1), [None] * (end + 1)
        dist[start], heap = 0, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, capacity, cost, _) in enumerate(graph[u]):
                if capacity and (dist[v] is None or d + cost + potential[u] - potential[v] < dist[v]):
                    dist[v] = d + cost + potential[u] - potential[v]
                    via[v] = (u, k)
                    heapq.heappush(heap, (dist[v], v))
        if dist[end] is None:
            break
        potential = [p + d if d is not None else p for p, d in zip(potential, dist, strict=True)]
        path, v = [], end
        while v != start:
            u, k = via[v]
            path.append((u, k))
            v = u
        push = min(graph[u][k][1] for u, k in path)
        for u, k in path:
            graph[u][k][1] -= push
            graph[graph[u][k][0]][graph[u][k][3]][1] += push
    out: list[dict[int, int]] = []
    for p in range(n_p):
        out.append({v - n_p: graph[v][back][1] for v, _, _, back in graph[p] if n_p <= v < start and graph[v][back][1]})
    return out


OUT = ("size", "source_size", "target", "taken")


def mix_to_targets(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", keep_text: bool = True, membership: str | None = None) -> DataFrame:
    """docs with size, source_size, target and taken.

    docs: doc_id, text, source; its other columns pass through whatever their names, save those four, which are replaced.
    size counts the words [^\\x20\\x09-\\x0D]+ of the text (null: 0). Sources are ordered by code point, null last (a
    source of its own); weights repeat along them. A document is taken 0 to `most` times, in an order given by md5 of seed
    and doc_id; at the end of a source's share one document is taken in part. Repeated rows are documents of their own.
    Texts are counted whole. An empty table gives an empty result; a source without words has target 0. Reruns and other
    partitionings give the same.

    membership names an array<string> column with all sources of a document in place of its one source; documents with
    the same sources make a pattern, and the flow says how many words each pattern gives to each of its sources.
    source_size and target are then the pattern's words and the words that the flow takes of it; an empty or null array
    gives nothing. Patterns (without membership: sources) are held to be few, as in a mixture's configuration: one row for
    each goes to the driver.

    keep_text=False leaves text out of the result, so that texts are read once only.
    """
    base = docs.drop(*OUT)
    h = free_name(base, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    place = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    own = F.array_sort(F.array_distinct(F.coalesce(F.col(f"`{membership}`"), F.array().cast("array<string>")))) if membership else F.array(F.col("source").cast("string"))
    sized = base.withColumn(h, F.struct(size.alias("size"), place.alias("place"), own.alias("pattern")))
    if not keep_text:
        sized = save(sized.drop("text"))
    col = lambda name: F.col(f"`{h}`.{name}")
    bin_of = lambda k: F.substring(col("place"), 1 + (k - 1) * DIGITS, DIGITS)
    bins = save(sized.groupBy(col("pattern").alias("pattern"), bin_of(1).alias("bin")).agg(F.sum(col("size")).alias("words")))
    rows = [(r["pattern"], r["words"]) for r in bins.groupBy("pattern").agg(F.sum("words").alias("words")).collect()]
    order = lambda x: (x is None, x or "")
    rows.sort(key=lambda r: [order(x) for x in r[0]])
    sources = sorted({x for pattern, _ in rows for x in pattern}, key=order)
    place_of = {x: i for i, x in enumerate(sources)}
    sizes = [0] * len(sources)
    for pattern, words in rows:
        for x in pattern:
            sizes[place_of[x]] += words
    targets = water_filled(sizes, [weights[i % len(weights)] for i in range(len(sources))], share, most, sum(words for _, words in rows))
    flow = routed([words for _, words in rows], [round(t) for t in targets], [[place_of[x] for x in pattern] for pattern, _ in rows], most)
    little = F.broadcast if len(rows) <= MOST_SOURCES else lambda t: t
    plan = []
    for (pattern, words), f in zip(rows, flow, strict=True):
        given = sum(f.values())
        rounds, tail = divmod(given, words) if words else (0, 0)
        plan.append((pattern, words, float(given) if membership else targets[place_of[pattern[0]]], rounds, tail))
    plan = docs.sparkSession.createDataFrame(plan, "pattern array<string>, source_size long, target double, rounds long, tail long")

    def end(bins: DataFrame, *before: str) -> DataFrame:
        """The bin of each pattern in which what is left of its tail ends: the bins ahead of it are taken once more as a whole."""
        ahead = F.sum("words").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        found = bins.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where("ahead < rest and rest <= ahead + words")
        return found.select("pattern", F.concat(*before, "bin").alias("bin"), (F.col("rest") - F.col("ahead")).alias("rest"))

    # bins of bins, so that the rows of the last one are few: one in 16 million of a pattern
    last = save(end(bins.join(little(plan.select("pattern", F.col("tail").alias("rest"))), "pattern")))
    inner = sized.select(col("pattern").alias("pattern"), bin_of(1).alias("first"), bin_of(2).alias("bin"), col("size").alias("size"))
    inner = inner.join(little(last.withColumnRenamed("bin", "first")), ["pattern", "first"]).groupBy("pattern", "first", "bin", "rest").agg(F.sum("size").alias("words"))
    last = save(end(inner, "first"))
    plan = plan.join(last, "pattern", "left").select("pattern", F.struct("source_size", "target", "rounds", "tail", "bin", "rest").alias("plan"))
    p, q = free_name(base, "plan"), free_name(base, "pattern")
    here = sized.join(little(plan.select(F.col("pattern").alias(q), F.col("plan").alias(p))), col("pattern") == F.col(q))
    got = lambda name: F.col(f"`{p}`.{name}")
    at = F.substring(col("place"), 1, 2 * DIGITS)
    extra = free_name(base, "extra")
    done = here.where(got("bin").isNull() | (at != got("bin"))).withColumn(extra, F.when(at < got("bin"), col("size")).otherwise(0))
    run = F.sum(col("size")).over(Window.partitionBy(q).orderBy(col("place"), "doc_id", col("size")).rowsBetween(Window.unboundedPreceding, -1))
    part = here.where(at == got("bin")).withColumn(extra, F.greatest(F.lit(0), F.least(col("size"), got("rest") - F.coalesce(run, F.lit(0)))))
    names = [F.col(f"`{c}`") for c in base.columns if keep_text or c != "text"]
    out = done.unionByName(part)
    return out.select(*names, col("size").alias("size"), got("source_size").alias("source_size"), got("target").alias("target"), (got("rounds") * col("size") + F.col(extra)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that mix_to_targets takes words of, with its columns; nulls, ties, empty tables and names as there."""
    return mix_to_targets(docs, **options).where("taken > 0")
