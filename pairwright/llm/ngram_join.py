"""N-gram Jaccard join with signature trees.

Documents become sets of word shingles (64-bit hashes). Equal sets form one class; classes that may link meet in
blocks by prefix filtering: of two sets with Jaccard >= t, each has one of its n - ceil(t n) + 1 first shingles in
common with the other, for any one order of all shingles. The order puts shingles of crowded sketch cells last (a
fixed-size count of all shingles, so passages that many documents share are in few prefixes), and among the others
those of rare words first (from a count of all words of the same kind), which unrelated documents hardly share. At its
place i in the order, a shingle of a set of n can only be the first common one of a pair if the other set has at most
(n - i) (1 + t) / t - n shingles; pairs are left to the block of their first common shingle by that rule.

In a block, a signature tree is built over the classes in order of size: leaves hold token bitmaps, inner nodes the
OR of their children's bitmaps and the range of sizes. Two trees are traversed together; a pair of nodes is left as
soon as the largest overlap that their bitmaps and sizes permit is below the threshold. Pairs that remain are never
listed: their rows go on to tasks that get the exact sets, each once, search the same blocks again among these rows
alone and check what they find. Links between rows that earlier links of the task join are left out, so a task returns
a spanning forest, fewer links than it has rows, however many copies of a family link with one another. One tree over the whole corpus would have saturated bitmaps near its root and prune nothing,
so the prefix shingles are the top of the hierarchy and each block has a tree of its own.

Blocks are contracted first: one edge a class, to the smallest class of its blocks, is checked and links are joined
to components; only blocks with several components are searched in full, and only between components. The blocks of one
family share most members and are searched in one task, which gets each signature once. In a large block, the component
with most rows need not meet itself: its rows are cut into parts that go nowhere else, and the other components' rows
meet each of these parts and one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import bytes_of, connected_components, forget, free_name, give_back, lists, map_arrow, mix, require, save, shingle_hashes, small, words

CELLS = 1 << 16
#: Signature bits of a class: twice its size, as a power of two in these bounds.
SIG_BITS = (256, 1 << 15)
#: How many times as many bits signatures have in blocks of more than PART classes.
FINE = 8
#: Classes of one block that one task holds; larger blocks are cut into parts.
PART = 512
LEAF, FANOUT = 8, 4
#: Rows that share one task of the search, about, and large blocks of one component that do.
TASK_ROWS, TASK_BLOCKS = 8192, 16
#: Shingles that one task of the exact check holds, about; larger meetings are cut into pieces that meet pairwise.
TASK_SHINGLES = 1 << 21
#: Pairs that a task remembers at most, so as not to find or check them again in its other blocks.
SEEN = 1 << 20
#: Cells of the filter on document ids ahead of exact checks; it is the most that is ever broadcast.
ID_CELLS = 1 << 18


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def crowding(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of all documents, CELLS numbers each: rank of a shingle's cell (0 up to twice the mean count, then more
    by half powers of two), and rank of a word's cell (quarter powers of two of its count)."""

    def run(batches):
        total = np.zeros(2 * CELLS, np.int64)
        for b in batches:
            data, at = bytes_of(b.column(0))
            for k, x in enumerate((shingle_hashes(data, at, width)[0], words(data, at)[0])):
                total[k * CELLS : (k + 1) * CELLS] += np.bincount((x & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])
        give_back()

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros(2 * CELLS)
    for cell, n in rows.collect():  # 2 * CELLS rows at most, whatever the input
        total[cell] = n
    shingle, word = total[:CELLS], total[CELLS:]
    crowd = np.ceil(2 * np.log2(np.maximum(shingle / max(shingle.mean(), 1e-9) / 2, 1)))
    rare = np.ceil(4 * np.log2(np.maximum(word / max(word.mean(), 1e-9), 0.25) * 4))
    return np.clip(crowd, 0, 31).astype(np.uint64), np.clip(rare, 0, 100).astype(np.int64)


def signature(x: np.ndarray, finer: int = 1) -> bytes:
    bits = min(max(1 << max(2 * len(x) - 1, 1).bit_length(), SIG_BITS[0]), SIG_BITS[1]) * finer
    out = np.zeros(bits, np.uint8)
    out[(mix(x) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """Two numbers that tell sets of shingles apart."""
    if len(s) == 0:
        return 0, 0
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(77))).view(np.int64))


def describe(docs: DataFrame, width: int, percent: int, crowd: np.ndarray, rare: np.ndarray) -> DataFrame:
    """doc_id, digest of the text, n, digest of the set (d1, d2), signature, prefix shingles of each document."""

    def one(batch):
        every, at, common = shingle_hashes(*bytes_of(batch.column(2)), width, rare)
        rank = crowd[(every & np.uint64(CELLS - 1)).astype(np.int64)]
        order = (rank << np.uint64(59)) | (np.minimum(common, 511).astype(np.uint64) << np.uint64(50)) | (mix(every) >> np.uint64(14))
        n, d1, d2, sigs, prefixes = [], [], [], [], []
        for i in range(batch.num_rows):
            s, first = np.unique(every[at[i] : at[i + 1]], return_index=True)
            k = len(s)
            n.append(k)
            for d, x in zip((d1, d2), digest_of(s), strict=True):
                d.append(x)
            sigs.append(signature(s) if k else b"")
            p = _prefix_size(k, percent)
            o = order[at[i] : at[i + 1]][first]
            pick = np.argpartition(o, p - 1)[:p] if 0 < p < k else np.arange(k)
            prefixes.append(s[pick[np.argsort(o[pick], kind="stable")]].view(np.int64))
        to = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(to), pa.array(flat))],
            ["doc_id", "t", "n", "d1", "d2", "sig", "prefix"],
        )

    return map_arrow(docs.select("doc_id", text_digest().alias("t"), F.col("text").cast("binary").alias("text")), one, "doc_id long, t long, n long, d1 long, d2 long, sig binary, prefix array<long>")


def text_digest() -> Column:
    """Tells apart the texts of rows with one doc_id."""
    return F.xxhash64(F.col("text").isNull(), F.col("text"))


def _most_common(a: np.ndarray, b: np.ndarray, na, nb) -> np.ndarray:
    """The largest overlap that signatures permit: of each set, no more than its size less its bits missing in the other."""
    bits = np.bitwise_count
    return np.minimum(na - bits(a & ~b).sum(-1, dtype=np.int64), nb - bits(b & ~a).sum(-1, dtype=np.int64))


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """A signature of fewer bits, by OR; a token's bit in it is the low part of its bit before."""
    while len(sig) > words:
        sig = sig[: len(sig) // 2] | sig[len(sig) // 2 :]
    return sig


class Tree:
    """Signature tree over rows in order of size. Each level has, for every node: the OR and the AND of its rows' bitmaps,
    smallest and largest size, the most tokens that any of its rows has beyond its bits, smallest and largest component,
    and the largest size that any of its rows may meet here."""

    def __init__(self, size: np.ndarray, sig: np.ndarray, comp: np.ndarray, reach: np.ndarray):
        self.size, self.sig, self.comp, self.reach = size, sig, comp, reach
        node = (sig, sig, size, size, size - np.bitwise_count(sig).sum(-1, dtype=np.int64), comp, comp, reach)
        gather = (np.bitwise_or, np.bitwise_and, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum, np.maximum)
        self.levels, step = [], LEAF
        while True:
            at = np.arange(0, len(node[0]), step)
            node = tuple(f.reduceat(x, at) for f, x in zip(gather, node, strict=True))
            self.levels.append(node)
            if len(at) == 1:
                return
            step = FANOUT


def may_link(a: tuple, i: int, b: tuple, j: int, percent: int) -> bool:
    """False if no row below node i of level a can link with one of another component below node j of level b."""
    any_a, all_a, lo_a, hi_a, spare_a, c1, c2, reach_a = (x[i] for x in a)
    any_b, all_b, lo_b, hi_b, spare_b, e1, e2, reach_b = (x[j] for x in b)
    if c1 == c2 == e1 == e2 or reach_a < lo_b or reach_b < lo_a or 100 * hi_a < percent * lo_b or 100 * hi_b < percent * lo_a:
        return False
    bits = lambda x: int(np.bitwise_count(x).sum(dtype=np.int64))
    most = min(bits(any_a & any_b) + min(int(spare_a), int(spare_b)), int(hi_a) - bits(all_a & ~any_b), int(hi_b) - bits(all_b & ~any_a))
    return (100 + percent) * most >= percent * (int(lo_a) + int(lo_b))


def joined(a: Tree, b: Tree, percent: int) -> Iterator[tuple[int, int]]:
    """Row pairs of different components whose largest possible overlap reaches the threshold; with a is b, each pair once."""
    same = a is b
    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        ka, i, kb, j = todo.pop()
        if not may_link(a.levels[ka], i, b.levels[kb], j, percent):
            continue
        if ka == kb == 0:
            x, y = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
            na, nb = a.size[x][:, None], b.size[y][None, :]
            most = _most_common(a.sig[x][:, None, :], b.sig[y][None, :, :], na, nb)
            fits = (100 * most >= percent * (na + nb - most)) & (a.comp[x][:, None] != b.comp[y][None, :])
            fits &= (nb <= a.reach[x][:, None]) & (na <= b.reach[y][None, :])
            u, v = np.nonzero(np.triu(fits, 1) if same and i == j else fits)
            yield from zip((u + i * LEAF).tolist(), (v + j * LEAF).tolist(), strict=True)
            continue
        # both sides go down together; the deeper tree catches up first
        down_a, down_b = ka >= kb, kb >= ka
        kids = lambda t, k, n, down: range(n * FANOUT, min((n + 1) * FANOUT, len(t.levels[k - 1][0]))) if down else (n,)
        for x in kids(a, ka, i, down_a):
            for y in kids(b, kb, j, down_b):
                if not same or x <= y:
                    todo.append((ka - down_a, x, kb - down_b, y))


def candidates(n: np.ndarray, reach: np.ndarray, comp: np.ndarray, ids: np.ndarray, home: np.ndarray, sigs: list, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of one meeting that may link: of home 0 with home 1, or of home 0 if there are no others."""
    width = min(map(len, sigs))
    sig = np.stack([fold(s, width) for s in sigs]).view(np.uint64)
    sides = []
    for h in (0, 1):
        rows = np.flatnonzero(home == h)
        rows = rows[np.lexsort((ids[rows], n[rows]))]
        sides.append((rows, Tree(n[rows], sig[rows], comp[rows], reach[rows])) if len(rows) else None)
    a = sides[0]
    b = sides[1] or a
    if a:
        for i, j in joined(a[1], b[1], percent):
            yield int(a[0][i]), int(b[0][j])


def meetings(rows: pa.Table) -> list[slice]:
    """Where the rows of each (block, part) are, of rows in that order; those of a single row are left out."""
    block, part = (rows.column(c).to_numpy() for c in ("block", "part"))
    cut = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
    return [slice(x, y) for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(block)], strict=True) if y - x > 1]


def link_blocks(members: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Of rows (task, block, part, home, id, n, reach, comp) those with a candidate: in each (block, part) two trees meet.

    home 0: rows of one part of the block; 1: rows of another part (if there are none, the first meets itself). sigs:
    (at, sig_id, sig), the signatures of a task's rows, each once. A pair that several blocks of a task have keeps its
    rows in the first of them only.
    """

    def search(rows: pa.Table, own: pa.Table) -> pa.Table:
        keep = np.zeros(rows.num_rows, bool)
        if rows.num_rows:
            rows = rows.sort_by([("block", "ascending"), ("part", "ascending")])
            n, reach, comp, ids, home = (rows.column(c).to_numpy() for c in ("n", "reach", "comp", "id", "home"))
            place = np.unique(ids, return_inverse=True)[1].tolist()
            sig_of = {i: np.frombuffer(s, np.uint8) for i, s in zip(own.column("sig_id").to_pylist(), own.column("sig").to_pylist(), strict=True)}
            seen: set[int] = set()
            for m in meetings(rows):
                for i, j in candidates(n[m], reach[m], comp[m], ids[m], home[m], [sig_of[i] for i in ids[m].tolist()], percent):
                    i, j = i + m.start, j + m.start
                    pair = min(place[i], place[j]) * len(place) + max(place[i], place[j])
                    if pair not in seen:
                        if len(seen) == SEEN:
                            seen.clear()
                        seen.add(pair)
                        keep[i] = keep[j] = True
        give_back()
        return rows.filter(pa.array(keep))

    return members.groupBy("task").cogroup(sigs.groupBy("at")).applyInArrow(search, members.schema)


def by_size(hits: DataFrame) -> DataFrame:
    """Rows of link_blocks dealt to tasks of TASK_SHINGLES, about. A meeting of more is cut into pieces, by id, and each
    two pieces (of its two sides, if it has two) meet; part is a string then."""
    load = hits.groupBy("task", "block", "part").agg(F.sum("n").alias("load"), F.max("home").alias("sides"))
    load = load.withColumn("pieces", F.ceil(F.col("load") / TASK_SHINGLES))
    salts = load.groupBy("task").agg(F.ceil(F.sum(F.col("load") * F.col("pieces")) / TASK_SHINGLES).alias("salts"))
    me = F.pmod(F.xxhash64("id"), F.col("pieces"))
    meeting = lambda i, j, home: F.struct(i.alias("i"), j.alias("j"), home.cast("int").alias("home"))
    among = lambda k: meeting(F.least(me, k), F.greatest(me, k), me > k)
    across = lambda k: meeting(F.when(F.col("home") == 0, me).otherwise(k), F.when(F.col("home") == 0, k).otherwise(me), F.col("home"))
    upto = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
    rows = hits.join(load.join(salts, "task").drop("task"), ["block", "part"])
    rows = rows.withColumn("t", F.explode(F.when(F.col("sides") == 0, F.transform(upto, among)).otherwise(F.transform(upto, across))))
    task = F.xxhash64("task", F.pmod(F.xxhash64("block", "part", "t.i", "t.j"), "salts"))
    return rows.select(task.alias("task"), "block", F.concat_ws(" ", "part", "t.i", "t.j").alias("part"), F.col("t.home").alias("home"), "id", "n", "reach", "comp")


def spanning_links(hits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows of by_size, checked on their exact sets (at, set_id, set): of each task a spanning forest of what its links join."""

    def check(rows: pa.Table, own: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if rows.num_rows:
            rows = rows.sort_by([("block", "ascending"), ("part", "ascending")])
            n, reach, comp, ids, home = (rows.column(c).to_numpy() for c in ("n", "reach", "comp", "id", "home"))
            values, at = lists(own.column("set").combine_chunks())
            set_of = {i: values[at[k] : at[k + 1]].view(np.uint64) for k, i in enumerate(own.column("set_id").to_pylist())}
            sig_of = {i: np.frombuffer(signature(s, FINE), np.uint8) for i, s in set_of.items()}
            parent: dict[int, int] = {}

            def find(x):
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            failed: set[tuple[int, int]] = set()
            for m in meetings(rows):
                comps, names = comp[m].tolist(), ids[m].tolist()
                now = np.array([find(c) for c in comps], np.int64)
                for i, j in candidates(n[m], reach[m], now, ids[m], home[m], [sig_of[i] for i in names], percent):
                    u, v = find(comps[i]), find(comps[j])
                    a, b = pair = min(names[i], names[j]), max(names[i], names[j])
                    if u == v or pair in failed:
                        continue
                    x, y = set_of[a], set_of[b]
                    k = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * k >= percent * (len(x) + len(y) - k):
                        parent[max(u, v)] = min(u, v)
                        links.append(pair)
                    else:
                        if len(failed) == SEEN:
                            failed.clear()
                        failed.add(pair)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        give_back()
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return hits.groupBy("task").cogroup(sets.groupBy("at")).applyInArrow(check, "a long, b long")


def small_blocks(labelled: DataFrame, several: DataFrame) -> DataFrame:
    """Rows of link_blocks for blocks of PART rows at most, dealt by their smallest component (and by block, if it has many)."""
    some = several.where(F.col("rows") <= PART)
    load = some.groupBy("low").agg(F.ceil(F.sum("rows") / TASK_ROWS).alias("salts"))
    some = some.join(load, "low").select("block", F.xxhash64("low", F.pmod(F.xxhash64("block"), "salts")).alias("task"))
    return labelled.join(some, "block").select("task", "block", F.lit(0).cast("long").alias("part"), F.lit(0).alias("home"), "id", "n", "reach", "comp")


def large_blocks(labelled: DataFrame, several: DataFrame) -> DataFrame:
    """Rows of link_blocks for larger blocks: the rows of the main component once for each part of the others, those of
    the others once for each part of the main component and of the others."""
    held = labelled.join(several.where(F.col("rows") > PART).select("block", "rows"), "block")
    each = held.groupBy("block", "comp").agg(F.count("*").alias("k"), F.first("rows").alias("rows"))
    main = each.groupBy("block").agg(F.max(F.struct("k", "comp")).alias("m"), F.first("rows").alias("rows"))
    parts = lambda n: F.lit(1).cast("long") * F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n / F.lit(PART), F.lit(1.0))))).cast("long")
    main = main.select("block", F.col("m.comp").alias("main"), parts(F.col("m.k")).alias("mains"), parts(F.col("rows") - F.col("m.k")).alias("others"))
    salts = main.groupBy("main").agg(F.ceil(F.count("*") / TASK_BLOCKS).alias("salts"))
    rows = held.drop("rows").join(main.join(salts, "main"), "block")
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # a meeting: part i of the others with part j of the main component (kind 0) or of the others (kind 1, i <= j)
    meeting = lambda kind, i, j, home: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), home.alias("home"))
    of_main = F.transform(upto(F.col("others")), lambda i: meeting(0, i, own(F.col("mains")), F.lit(1)))
    me = own(F.col("others"))
    of_others = F.concat(
        F.transform(upto(F.col("mains")), lambda j: meeting(0, me, j, F.lit(0))),
        F.transform(upto(F.col("others")), lambda j: meeting(1, F.least(me, j), F.greatest(me, j), (me > j).cast("int"))),
    )
    rows = rows.withColumn("t", F.explode(F.when(F.col("comp") == F.col("main"), of_main).otherwise(of_others)))
    task = F.xxhash64("main", "t.kind", "t.i", "t.j", F.pmod(F.xxhash64("block"), "salts"))
    part = (F.col("t.i") * F.greatest("mains", "others") + F.col("t.j")) * 2 + F.col("t.kind")
    return rows.select(task.alias("task"), "block", part.alias("part"), F.col("t.home").alias("home"), "id", "n", "reach", "comp")


def bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that sizes and signatures permit to link."""
    s = reps.select("id", "n", "sig")
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(
        s.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b"
    )
    both = both.where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))

    def keep(batch):
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        ok = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            w = min(len(x), len(y))
            most = int(_most_common(fold(x, w).view(np.uint64), fold(y, w).view(np.uint64), na[i], nb[i]))
            ok[i] = 100 * most >= percent * (na[i] + nb[i] - most)
        return pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return map_arrow(both.select("a", "b", "na", "nb", "sa", "sb"), keep, "a long, b long")


def sets_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, set) of classes (id, doc_id, d1, d2); only documents whose doc_id may be among them are shingled again."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_CELLS))
    cells = classes.select(cell("doc_id").alias("cell")).distinct()  # ID_CELLS rows at most
    some = docs.withColumn("cell", cell("doc_id")).join(F.broadcast(cells), "cell", "left_semi")

    def sets(batch):
        x, at = shingle_hashes(*bytes_of(batch.column(1)), width)
        parts = [np.unique(x[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
        digests = np.array([digest_of(s) for s in parts], np.int64).reshape(-1, 2)
        to = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(to), pa.array(np.concatenate(parts).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), flat], ["doc_id", "d1", "d2", "set"])

    s = map_arrow(some.select("doc_id", F.col("text").cast("binary").alias("text")), sets, "doc_id long, d1 long, d2 long, set array<long>")
    return s.join(classes, ["doc_id", "d1", "d2"]).select("id", "set").dropDuplicates(["id"])


def linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose exact sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    classes = save(reps.select("id", "doc_id", "d1", "d2").join(ids, "id", "left_semi"))
    s = save(sets_of(docs, classes, width))
    # b first: a hub is an a, and its many pairs then meet its set straight from a shuffle, which can be split there
    both = pairs.join(s.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(s.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    out = save(both.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b"))
    forget(s, classes)
    return out


def fine_signatures(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, sig) with FINE times the bits, for the members of large blocks, where many pairs are near the threshold."""

    def fine(batch):
        column = batch.column(1)
        off, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        sigs = [signature(values[off[i] : off[i + 1]], FINE) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], ["id", "sig"])

    return map_arrow(sets_of(docs, classes, width), fine, "id long, sig binary")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, t (text_digest), n, component (a number of this run's, null for empty sets), component_id of every row of docs (doc_id long, text)."""
    all_docs = save(describe(docs, width, percent, *crowding(docs, width)))
    # a class: all documents with one set; its id is a number of this run's, unlike doc_id never shared by two sets
    reps = all_docs.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "sig", "prefix")).alias("r"))
    reps = save(reps.select(F.monotonically_increasing_id().alias("id"), "r.doc_id", "n", "d1", "d2", "r.sig", "r.prefix"))
    entries = reps.select("id", "n", F.posexplode("prefix").alias("place", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key")
    # size classes: two sets that link are in one class or in adjacent ones
    step = math.log(100 / percent) if percent < 100 else 1.0
    home = F.floor(F.log("n") / F.lit(step) + F.lit(1e-9)).cast("long")
    reach = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent).cast("long") - F.col("n")
    classes = F.when(reach + 1 >= F.exp((home + 1) * F.lit(step)), F.array(home, home + 1)).otherwise(F.array(home))
    met = entries.join(shared, "key").select(F.explode(classes).alias("size_class"), reach.alias("reach"), "key", "id", "n")
    met = save(met.select(F.xxhash64("key", "size_class").alias("block"), "id", "n", "reach"))
    # one edge a class, to the smallest class of its blocks
    hub = met.groupBy("block").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("block", "hub")
    first = met.join(hub, "block").groupBy("id").agg(F.min("hub").alias("hub")).where("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    pairs = save(bounded(first, reps, percent))
    links = linked(pairs, reps, docs, width, percent)
    forget(pairs)
    comp = save(connected_components(links))
    # blocks with several components, searched in full between them
    labelled = save(met.join(comp, "id", "left").select("block", "id", "n", "reach", F.coalesce("component", "id").alias("comp")))
    forget(met, comp)
    several = labelled.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows")).where("low < high")
    several = save(several.select("block", "low", "rows"))
    members = save(small_blocks(labelled, several))
    of_task = lambda rows: rows.select(F.col("task").alias("at"), F.col("id").alias("sig_id")).distinct()
    sigs = of_task(members).join(reps.select(F.col("id").alias("sig_id"), "sig"), "sig_id").select("at", "sig_id", "sig")
    large = None
    if not several.where(F.col("rows") > PART).isEmpty():
        large = save(large_blocks(labelled, several))
        fine = fine_signatures(docs, reps.select("id", "doc_id", "d1", "d2").join(large.select("id").distinct(), "id", "left_semi"), width)
        sigs = sigs.unionByName(of_task(large).join(fine.withColumnRenamed("id", "sig_id"), "sig_id").select("at", "sig_id", "sig"))
    every = members if large is None else members.unionByName(large)
    found = save(link_blocks(every, sigs, percent))
    forget(labelled, several, members, *([] if large is None else [large]))
    hits = save(by_size(found))
    left = save(reps.select("id", "doc_id", "d1", "d2").join(hits.select("id").distinct(), "id", "left_semi"))
    sets = save(sets_of(docs, left, width))
    own = hits.select(F.col("task").alias("at"), F.col("id").alias("set_id")).distinct().join(sets.withColumnRenamed("id", "set_id"), "set_id")
    more = save(spanning_links(hits, own.select("at", "set_id", "set"), percent))
    forget(found, hits, left, sets)
    comp = connected_components(links.unionByName(more))
    classes = save(reps.join(comp, "id", "left").select("doc_id", "d1", "d2", "n", F.coalesce("component", "id").alias("component")))
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = classes.drop("doc_id").join(least, "component")
    return all_docs.select("doc_id", "t", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left").select("doc_id", "t", "n", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents by Jaccard similarity of their word shingles: doc_id, n_shingles, component_id.

    docs: doc_id, text; other columns are ignored, whatever their names. One row is returned for each row of docs.
    A-Z counts as a-z; words are split at [\\x20\\x09-\\x0D]. Null, empty and blank texts have no shingle, link with
    nothing and are their own component. Rows with equal doc_id count as copies of one another only if their sets are
    equal or link. A null doc_id is never a component's id: such a row gets the smallest id that it reaches, or null.
    An empty table gives an empty result.
    """
    docs = require(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return grouped(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs, where of the rows of each (doc_id, t) of repeated one stays: the one with the smallest hash of all its columns. No other row is touched."""
    i, t, row = free_name(docs, "id"), free_name(docs, "t"), free_name(docs, "row")
    repeated = save(repeated.select(F.col("doc_id").alias(i), F.col("t").alias(t)))
    if repeated.isEmpty():
        return docs
    same = (F.col("doc_id").cast("long") == F.col(i)) & (text_digest() == F.col(t))
    names = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # Spark hashes no maps
    one = docs.join(small(repeated), same).groupBy(i, t).agg(F.min_by(F.struct(*names), F.xxhash64(*hashed)).alias(row)).select(f"{row}.*")
    return docs.join(small(repeated), same, "left_anti").unionByName(one)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates: of each component the row with the smallest doc_id stays, and every row that links with nothing.

    Rows are told apart by doc_id and text: of several rows with that smallest doc_id in one component one stays, while a
    row of that doc_id in another component, or in none, is not touched. Rows with equal doc_id and text stay once (the one
    with the smallest hash of all columns). Rows with a null doc_id stay, as nothing could name them. Null, empty and blank texts link with nothing and stay. Columns
    keep their names and order, whatever they are. An empty table gives an empty result.
    """
    base = require(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = save(grouped(base, width, percent).where("doc_id is not null"))
    keys = save(found.groupBy("doc_id", "t").agg(F.first("component").alias("component"), F.first("component_id").alias("component_id"), F.count("*").alias("k")))
    docs = _once(docs, keys.where("k > 1").select("doc_id", "t"))
    linked_rows = keys.where("component is not null")
    # one doc_id several times in a component: the text with the smallest digest stays
    heads = linked_rows.where("doc_id = component_id")
    twice = save(heads.groupBy("component").agg(F.min("t").alias("least"), F.count("*").alias("texts")).where("texts > 1").select("component", "least"))
    gone = linked_rows.where("doc_id <> component_id").select("doc_id", "t").unionByName(heads.join(small(twice), "component").where("t <> least").select("doc_id", "t"))
    i, t = free_name(docs, "id"), free_name(docs, "t")
    gone = save(gone.select(F.col("doc_id").alias(i), F.col("t").alias(t)))
    return docs.join(small(gone), (F.col("doc_id") == F.col(i)) & (text_digest() == F.col(t)), "left_anti")
