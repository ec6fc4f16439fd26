"""The pair matcher's candidates, blocks of ties, folding, conflict values and providers, against plain versions and literal rows."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pairwright import config
from pairwright.functions import text as T
from pairwright.operators import matching

def order():
    return [F.desc("sim"), F.col("a_id"), F.col("b_id")]


def sequential(edges):
    used_a, used_b, out = set(), set(), set()
    for _, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add((a, b))
    return out


def test_equal_titles_are_settled_in_few_rounds(spark):
    a, b = spark.range(1000).select(F.col("id").alias("a_id")), spark.range(700).select((F.col("id") * 3).alias("b_id"))
    edges = a.join(b, on=F.lit(True)).select(F.lit("g").alias("g"), "a_id", "b_id", F.lit(0.9).alias("sim"))
    got, rounds = matching.greedy_rounds(edges, ["g"], order(), ["sim"])
    assert {(r.a_id, r.b_id) for r in got.collect()} == {(i, 3 * i) for i in range(700)} and rounds == 1


@pytest.mark.parametrize("seed", range(2))
def test_blocks_equal_the_sequential_choice(spark, seed):
    """Few distinct similarities, classes of equal listings with gaps, and edges that wait for better ones."""
    r, rows, want = random.Random(seed), [], set()
    for g in range(12):
        kinds = {(x, y): r.choice([None, 0.5, 0.5, 0.7]) for x in range(3) for y in range(3)}
        a, b = [r.randrange(3) for _ in range(9)], [r.randrange(3) for _ in range(8)]
        edges = [(kinds[x, y], i, j) for i, x in enumerate(a) for j, y in enumerate(b) if kinds[x, y] and (g % 2 or r.random() < 0.9)]
        rows += [(g, i, j, s) for s, i, j in edges]
        want |= {(g, i, j) for i, j in sequential(edges)}
    df = spark.createDataFrame(rows, "g int, a_id int, b_id int, sim double")
    got, rounds = matching.greedy_rounds(df, ["g"], order(), ["sim"])
    assert {(x.g, x.a_id, x.b_id) for x in got.collect()} == want and rounds < 10
    assert matching.greedy_pairs(df.limit(0), ["g"], order(), ["sim"]).count() == 0


def quick(a, b):
    x, y = ({w for w in re.sub("[^a-z0-9]+", " ", t).split() if len(w) > 1 and w not in T.STOPWORDS} for t in (a, b))
    if not x or not y:
        return 0.0
    n = len(x & y)
    score = 0.5 * (n / (len(x) + len(y) - n)) + 0.5 * (n / min(len(x), len(y)))
    same = sum(m in re.findall(r"\d{3,}", b) for m in re.findall(r"\d{3,}", a))
    return min(1.0, score + 0.08 * same) if same else score


@pytest.mark.parametrize("most,floor", [(5, 0.22), (40, 0.22), (3, 0.05), (10_000, 0.22)])
def test_best_candidates_equal_the_full_sort(spark, most, floor):
    r = random.Random(most)
    words = [f"w{i}" for i in range(12)] + ["x100", "m2000m300m400", "500", "600", "777", "the"]
    title = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 7)))
    sides = [[(g, i, title()) for g in range(4) for i in range(25 if g else 3)] for _ in range(2)]
    # pairs that numbers alone lift
    sides[0].append((9, 1, "ab111 ab222 ab333 ab444"))
    sides[1].append((9, 1, "cd111 cd222 cd333 cd444"))
    a, b = (matching.with_tokens(spark.createDataFrame(s, "g int, id int, title string")) for s in sides)
    want = []
    for g in {x[0] for x in sides[0]}:
        all_pairs = [(quick(t, u), i, j) for h, i, t in sides[0] if h == g for k, j, u in sides[1] if k == g]
        want += [(g, i, j, round(s, 9)) for s, i, j in sorted((p for p in all_pairs if p[0] >= floor), key=lambda p: (-p[0], p[1], p[2]))[:most]]
    got = [(x.g, x.a_id, x.b_id, round(x.quick, 9)) for x in matching.best_candidates(a, b, ["g"], floor, most).collect()]
    assert sorted(got) == sorted(want) and any(w[0] == 9 for w in want)


def test_most_pairs_are_never_made(spark):
    """Titles that all share common words, a third of which are sold on both sides."""
    r = random.Random(8)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(600)]
    titles = [r.sample(common, 4) + r.sample(rare, 4) for _ in range(500)]
    sides = [[(1, i, " ".join(t)) for i, t in enumerate(titles[:300])], [(1, i, " ".join(t[1:])) for i, t in enumerate(titles[200:])]]
    a, b = (matching.with_tokens(spark.createDataFrame(s, "g int, id int, title string")) for s in sides)
    made = matching.reachable_pairs(a, b, ["g"], config.PAIR_FLOOR, 50).count()
    assert 50 <= made < 0.05 * 300 * 300


def test_folding_of_compatibility_forms(spark):
    rows = {"½ inch": "1 2 inch", "ﬁne ofﬁce": "fine office", "① and ⑫": "1 and 12", "Ｆｕｌｌ Ｗｉｄｔｈ": "full width", "Café ÅNGSTRÖM": "cafe angstrom", "5㎏ x²": "5kg x2", "𝟑d": "3d", "™ mark": "mark", "straße": "stra e", "ĳs ŀa": "ijs l a", "日本 tv": "tv"}
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", "t", T.fold_key(F.col("t")).alias("k"))
    assert {r.t: r.k for r in df.collect()} == rows
    # every character that is its own small letter, against its decomposition
    chars = [chr(c) for c in (*range(0x20, 0x3000), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)) if chr(c).lower() == chr(c)]
    fold = lambda s: re.sub("[^a-z0-9]+", " ", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", s))).strip()
    got = spark.createDataFrame([(c, f"a{c}b") for c in chars], "c string, t string").select("c", T.fold_key(F.col("t")).alias("k")).collect()
    assert not [(r.c, r.k) for r in got if r.k != fold(f"a{r.c}b")]


def test_spam_words_go_and_case_may_stay(spark):
    df = spark.createDataFrame([("FAST Free Shipping Logitech MX Master WOW",)], "t string")
    assert tuple(df.select(T.strip_spam(F.col("t")), T.strip_spam(F.col("t"), keep_case=True)).first()) == ("logitech mx master", "Logitech MX Master")


def features(spark, rows):
    return matching.pair_features(spark.createDataFrame([(1, *r) for r in rows], "g int, id int, title string, image string, condition string"))


def test_conflicts_carry_values(spark):
    a = features(spark, [(1, "Crucial X9 SSD 2TB black", None, "new"), (2, "Logitech m185x keyboard bundle", None, None)])
    b = features(spark, [(9, "Crucial X9 SSD 512GB white", None, "used"), (8, "Logitech m200x keyboard", None, None)])
    found = {(r.a_id, r.b_id): {c.attribute: (c.policy, c.a_value, c.b_value) for c in r.conflicts} for r in matching.score_pairs(a, b, ["g"]).collect()}
    assert found[1, 9]["storage"] == ("reject", "2048", "512") and found[1, 9]["condition"] == ("reject", "new", "used") and "color" not in found[1, 9]
    assert found[2, 8]["bundle"] == ("penalize", "bundle", "single item")
    assert found[2, 8]["model"] == ("reject", '["M185X"]', '["M200X"]')


def test_provider_is_held_to_its_range(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate((3.0, -1.0, 0.25, float("nan"), float("inf"), None))], "i int, v double").withColumn("w", F.array(F.lit("x")))
    assert [r.s for r in rows.select("i", matching._held(lambda a, b: F.col("v"), F.col("w"), F.col("w")).alias("s")).orderBy("i").collect()] == [1.0, 0.0, 0.25, 0.0, 0.0, 1.0]


def test_limits_of_the_pair_matcher(spark):
    a = features(spark, [(i, f"Anker cable model ab{i}cd usb", None, "new") for i in range(6)])
    b = features(spark, [(i, f"Anker cable model ab{i}cd usb", None, "new") for i in range(6)])
    every = {(r.a_id, r.b_id): r.score for r in matching.score_pairs(a, b, ["g"]).collect()}
    some = {(r.a_id, r.b_id): r.score for r in matching.score_pairs(a, b, ["g"], most=6).collect()}
    assert len(every) == 36 and some == {(i, i): every[i, i] for i in range(6)}
    pairs = matching.confident_pairs(matching.score_pairs(a, b, ["g"]), ["g"], most=2).collect()
    assert sorted((p.a_id, p.b_id) for p in pairs) == [(0, 0), (1, 1)]
