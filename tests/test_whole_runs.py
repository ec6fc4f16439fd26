"""Queries and operators on runs with far more listings than the test tables have."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairwright.functions import text as T
from pairwright.operators import matching, pages
from pairwright.plans import catalogue
from pairwright.session import once_each
from pairwright.sources import listings


@pytest.fixture
def tables(spark, tmp_path):
    """Writes part and lineitem: parts (key, name), each sold by so many suppliers."""

    def write(parts, suppliers):
        p = [(k, "Brand#11", name, 7, "STANDARD TIN", 100.0 + k) for k, name in parts]
        spark.createDataFrame(p, "p_partkey long, p_brand string, p_name string, p_size int, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
        lines = [(k, s, 10.0 * (s + 1), 2.0, 0.01) for k, _ in parts for s in range(suppliers)]
        spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
        return str(tmp_path)

    return write


def test_merge_counts_all_rows_of_a_run(spark, tables):
    [row] = catalogue.merge_capped(spark, tables([(1, "red cup")], 1100)).collect()
    # each offer of page 1, and those of page 2 whose id went
    assert row["with_id"] == 1100 and row["rows"] == 1100 + sum((100000000 + s) % 10 == 0 for s in range(1100))
    capped = pages.merged(spark.range(1100).selectExpr("1 as g", "id", "id as page"), ["g"], ["page"])
    assert capped.count() == pages.MERGE_CAP


def _sides(spark, seed):
    """Titles of few words, many of them alike, on both sides of three runs."""
    r = random.Random(seed)
    title = lambda: " ".join(r.choice(["red", "blue", "mouse", "x100", "m2000", "cup", "777"]) for _ in range(r.randint(1, 4)))
    rows = [[(g, i, title()) for i, g in enumerate(r.choices(range(3), k=n))] for n in (60, 140)]
    return [spark.createDataFrame(x, "g int, id int, title string") for x in rows]


@pytest.mark.parametrize("most", [1, 4, 80])
def test_first_pairs_equal_the_capped_walk_over_all_pairs(spark, most):
    a, b = _sides(spark, most)
    edges = matching.candidate_pairs(matching.with_tokens(a), matching.with_tokens(b), ["g"]).collect()
    want, used = [], {}
    for e in sorted(edges, key=lambda e: (-e.sim, e.a_id, e.b_id)):
        ends = used.setdefault(e.g, [])
        if len(ends) < most and not any(e.a_id == x or e.b_id == y for x, y in ends):
            ends.append((e.a_id, e.b_id))
            want.append((e.g, e.a_id, e.b_id, e.sim))
    got = [tuple(x) for x in matching.first_pairs(a, b, ["g"], most=most).collect()]
    assert got and sorted(got) == sorted(want)


@pytest.mark.parametrize("most", [3, 50])
def test_candidates_of_equal_titles_equal_the_full_sort(spark, most):
    a, b = _sides(spark, 7)
    edges = sorted(matching.candidate_pairs(matching.with_tokens(a), matching.with_tokens(b), ["g"], 0.22).collect(), key=lambda e: (-e.sim, e.a_id, e.b_id))
    want = [tuple(e) for g in range(3) for e in [e for e in edges if e.g == g][:most]]
    assert sorted(tuple(x) for x in matching.best_candidates(a, b, ["g"], 0.22, most).collect()) == sorted(want)


def test_classes_hold_the_least_ids_only(spark):
    rows = spark.range(500).selectExpr("1 as g", "id", "if(id % 2 = 0, 'red mouse', 'the mouse red') as title")
    [c] = matching.listing_classes(rows, ["g"], 5).collect()
    assert (c.id, c.ids) == (0, [0, 1, 2, 3, 4])


def test_alternatives_of_equal_titles_follow_each_price(spark):
    left = spark.createDataFrame([(1, i, "green power bank stand", None, p) for i, p in enumerate((5.0, 50.0, 500.0))], "g int, id int, title string, gtin string, total_price double")
    right = spark.createDataFrame([(1, i, "power bank blue case", p, None, i) for i, p in enumerate((490.0, 48.0, 4.0))], "g int, id int, title string, price double, quantity int, rank int")
    scored = matching.best_of_n(left, right, ["g"])
    rows = scored.orderBy("l_id", "place").collect()
    # a title's candidates are found once; what is cheaper and near in price comes first for each listing
    assert [r.r_id for r in rows if r.place == 1] == [2, 1, 0] and [r.matched for r in rows if r.place == 1] == [r.accepted for r in rows if r.place == 1]
    shown = matching.alternatives(scored, ["g"]).collect()
    for i in range(3):
        rest = [r.r_id for r in rows if r.l_id == i and r.score >= 0.35 and not r.accepted]
        assert [r.r_id for r in sorted(shown, key=lambda r: r.shown) if r.l_id == i] == rest
        assert sorted(r.shown for r in shown if r.l_id == i) == list(range(1, len(rest) + 1))


def test_equal_titles_are_read_once(spark, tables):
    """A thousand suppliers of one part have 24 titles."""
    seen = spark.sparkContext.accumulator(0)

    def counted(t):
        def add(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return t.mapInArrow(add, t.schema).withColumn("cleaned", T.strip_spam(F.col("title")))

    sf_dir = tables([(1, "red cup")], 1000)
    o = listings.offers(spark, sf_dir).select("id", "title")
    rows = once_each(o, ["title"], counted).collect()
    assert len(rows) == 1000 and seen.value <= 24 and len({r.title for r in rows}) == seen.value
    assert sorted(map(tuple, catalogue.strip_spam(spark, sf_dir).collect())) == sorted((r.id, r.cleaned) for r in rows)
    nulls = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, title string")
    assert {r.id: r.cleaned for r in once_each(nulls, ["title"], lambda t: t.withColumn("cleaned", F.coalesce("title", F.lit("-")))).collect()} == {1: "-", 2: "-", 3: "a"}


def test_tokens_of_equal_titles_are_listed_once(spark, tables, monkeypatch):
    folder = tables([(8400 * k, "red cup") for k in range(1, 4)], 240)
    made = []
    monkeypatch.setattr(catalogue, "spread", lambda df, *by: made.append((df.count(), df.columns)) or df)
    got = {r["id"]: r["picked"] for r in catalogue.token_rank_top6(spark, folder).collect()}
    titles = {r["id"]: r["title"] for r in listings.offers(spark, folder).collect()}
    assert len(got) == 720 and got.keys() == titles.keys() and made[0][0] == len(set(titles.values())) < 400
    # against each title by itself: the six best words, by length, digits and the offers that hold them
    words = {i: list(dict.fromkeys(w for w in t.split() if len(w) > 1)) for i, t in titles.items()}
    often = Counter(w for ws in words.values() for w in ws)
    value = lambda w: (0.5 + 0.5 * min(len(w), 12) / 12 + (0.25 if re.search("[0-9]", w) else 0)) * (0.6 + 0.4 / math.log(1 + often[w]))
    for i, t in titles.items():
        best = sorted(words[i], key=lambda w: (-round(value(w), 9), t.split().index(w)))[:6]
        assert got[i] == " ".join(sorted(best, key=t.split().index))


def test_tasks_that_sort_pages_grow_with_the_rows(spark, tables, monkeypatch):
    folder = tables([(1, "red cup"), (2, "blue cup")], 300)
    monkeypatch.setattr(pages, "TASK_ROWS", 100)
    rows = catalogue._repeated(spark, folder)
    first = pages.first_of_each(rows, ["run"], ["page", "id"], catalogue._repeated_rows(spark, folder))
    assert first.rdd.getNumPartitions() == 9 and first.count() == pages.first_of_each(rows, ["run"], ["page", "id"]).count()
    merged = pages.merged(rows, ["run"], ["page", "id"], None, catalogue._repeated_rows(spark, folder))
    assert merged.rdd.getNumPartitions() == 9 and merged.count() == pages.merged(rows, ["run"], ["page", "id"], None).count()


def test_prices_are_read_for_the_paired_offers_alone(spark, tables):
    """Offers of some ids are those of all offers; the lines of the others are neither grouped nor shuffled."""
    where = tables([(p, "red bolt") for p in range(4)], 3)
    every = listings.offers(spark, where)
    only = every.where("id % 2 = 0").select("id")
    got = listings.offers(spark, where, only)
    rows = lambda t: sorted(map(str, t.collect()))
    assert rows(got) == rows(every.where("id % 2 = 0")) and rows(listings.offers(spark, where, only.limit(0))) == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
