"""best_of_n by rows of classes: equal to a plain choice by listing, and nothing sorts or spills pairs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright import config
from pairwright.functions.similarity import blend
from pairwright.functions.text import fold_key, long_tokens, strip_spam
from pairwright.operators import matching

WORDS = ["anker", "cable", "usb", "m185x", "black", "2 pack", "128gb", "ssd", "sony", "red", "unlike", "thing", "012345678905"]


def _sides(spark, seed, n):
    r = random.Random(seed)
    titles = [" ".join(r.sample(WORDS, r.randint(1, 5))) for _ in range(9)] + [None, "", "zzz qqq"]
    left = [(i % 3, i, r.choice(titles), r.choice([None, "012345678905", "5", ""]), r.choice([None, 0.0, 5.0, 20.0])) for i in range(n)]
    right = [(g, 100 * g + k, r.choice([*titles, *WORDS]), r.choice([None, 4.0, 30.0]), r.choice([None, 2]), k) for g in range(3) for k in range((2, 20, 70)[g])]
    return spark.createDataFrame(left, "g int, id long, title string, gtin string, total_price double"), spark.createDataFrame(right, "g int, id long, title string, price double, quantity int, rank int")


@pytest.mark.parametrize("most", [2, 1024])
def test_candidates_are_those_of_each_listing(spark, monkeypatch, most):
    """The screened candidates and their number, by a window over all pairs of listings."""
    monkeypatch.setattr(matching, "CLASS_IDS", most)
    left, right = _sides(spark, 1, 60)
    tokens = lambda t: long_tokens(fold_key(strip_spam(F.col(t))))
    pairs = left.select("g", F.col("id").alias("l_id"), "gtin", tokens("title").alias("x")).join(right.where(F.col("rank") < config.SCREENED).select("g", F.col("id").alias("r_id"), "rank", tokens("title").alias("y")), "g")
    w = Window.partitionBy("g", "l_id")
    pairs = pairs.withColumn("screen", blend(F.col("x"), F.col("y"))).withColumn("ok", (F.col("screen") >= config.SCREEN_FLOOR) | F.col("gtin").isNotNull()).withColumn("any", F.max("ok").over(w))
    pairs = pairs.where(F.col("ok") | (~F.col("any") & (F.col("rank") < 3))).withColumn("screen", F.when(F.col("any"), F.col("screen")).otherwise(0.0))
    want = pairs.withColumn("n", F.row_number().over(w.orderBy(F.desc("screen"), "rank"))).where(F.col("n") <= config.SCORED)
    rows = lambda t: sorted(tuple(r) for r in t.select("g", "l_id", "r_id", "screen").collect())
    got = matching.best_of_n(left, right, ["g"])
    assert rows(got) == rows(want) and got.where("place = 1").count() == 60


@pytest.mark.parametrize("most", [2, 1024])
def test_accepted_classes_hold_what_best_of_n_accepts(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "CLASS_IDS", most)
    left, right = _sides(spark, 2, 60)
    got = matching.accepted_classes(matching.candidate_classes(left, right, ["g"]), ["g"]).select("g", "l_title", "l_pack", F.explode("accepted").alias("x"))
    got = got.select("g", "x.member.id", "l_title", "l_pack", "x.best.r_id", "x.best.score")
    want = matching.best_of_n(left, right, ["g"]).where("accepted").select("g", "l_id", "l_title", "l_pack", "r_id", "score")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count()


def test_pairs_are_not_sorted(spark):
    """Pairs in a window, or grouped by listing, went to disk: several GB at 6 times sf0.1. Only the listings of a title are numbered."""
    left, right = _sides(spark, 3, 5)
    plan = matching.best_of_n(left, right, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Join ") == 1
