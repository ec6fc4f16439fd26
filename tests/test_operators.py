"""Matching, guards, leads, pages, sources and streaming on small tables."""

import csv
import io
import random

from pyspark.sql import functions as F

from pairwright.operators import guards, leads, matching, pages
from pairwright.operators.search import built_query
from pairwright.sources import captures, urls
from pairwright.streaming import runs


def _greedy(edges):
    used_a, used_b, out = set(), set(), set()
    for s, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add((a, b))
    return out


def test_greedy_equals_sequential(spark):
    r, rows, want = random.Random(3), [], set()
    for g in range(12):
        edges = [(r.choice([0.4, 0.5, 0.6, 0.9]), a, b) for a in range(8) for b in range(9) if r.random() < 0.4]
        rows += [(g, a, b, s) for s, a, b in edges]
        want |= {(g, a, b) for a, b in _greedy(edges)}
    df = spark.createDataFrame(rows, "g int, a_id int, b_id int, sim double")
    got = matching.greedy_pairs(df, ["g"], [F.desc("sim"), F.col("a_id"), F.col("b_id")]).collect()
    assert {(x["g"], x["a_id"], x["b_id"]) for x in got} == want
    assert matching.greedy_pairs(df.limit(0), ["g"], [F.desc("sim")]).count() == 0


def test_token_join_finds_what_the_full_comparison_finds(spark):
    r = random.Random(5)
    title = lambda: " ".join(r.choice(["red", "blue", "mouse", "x100", "m2000", "cup", "lamp", "5000", "777"]) for _ in range(r.randint(0, 5)))
    a, b = ([(i, title()) for i in range(40)] for _ in range(2))
    a, b = (matching.with_tokens(spark.createDataFrame(t, "id int, title string").withColumn("k", F.lit(1))) for t in (a, b))
    full = {(x.a_id, x.b_id, round(x.sim, 9)) for x in matching.candidate_pairs(a, b, ["k"]).collect()}
    assert full and full == {(x.a_id, x.b_id, round(x.sim, 9)) for x in matching.candidate_pairs_by_token(a, b).collect()}


def _best(spark, left, right):
    l = spark.createDataFrame([(1, 1, *left)], "g int, id int, title string, gtin string, total_price double")  # noqa: E741
    r = spark.createDataFrame([(1, i, t, p, None, i) for i, (t, p) in enumerate(right)], "g int, id int, title string, price double, quantity int, rank int")
    return matching.best_of_n(l, r, ["g"]).orderBy("place").collect()


def test_best_of_n_scenarios(spark):
    got = _best(spark, ("Logitech MX Master 3S Wireless Mouse", None, 90.0), [("Sony WH-1000XM5 Headphones", 200.0), ("Logitech MX Master 3S Wireless Mouse Graphite", 80.0), ("Desk lamp", 10.0)])
    assert got[0].r_id == 1 and got[0].accepted and got[0].score >= 0.75
    two = _best(spark, ("Stanley Tumbler 40oz 2 Pack", None, 60.0), [("Stanley Tumbler 40oz", 30.0), ("Stanley Tumbler 40oz 2 Pack", 55.0)])
    assert two[0].r_id == 1
    low = _best(spark, ("Vintage brass door hinge", None, 20.0), [("USB charging cable", 9.0)])
    assert not low[0].accepted and low[0].score < 0.6
    decoys = [(f"Unrelated thing number {i} lamp", 5.0) for i in range(12)] + [("Anker PowerCore M123X power bank", 20.0)]
    assert _best(spark, ("Anker PowerCore M123X power bank", None, 25.0), decoys)[0].r_id == 12
    many = _best(spark, ("Thing", "012345678905", 25.0), [(f"Unrelated {i}", 5.0) for i in range(30)])
    assert len(many) == 15


def test_best_of_n_prefers_the_cheaper(spark):
    got = _best(spark, ("Oral care kit brush", None, 9.99), [("Oral care kit brush", 27.99), ("Oral care kit brush", 10.49)])
    assert got[0].r_id == 1


def test_pair_scores_and_conflicts(spark):
    a = spark.createDataFrame([(1, 1, "Crucial X9 SSD 1TB", None, "new"), (1, 2, "Crucial X9 SSD 2TB", None, "new")], "g int, id int, title string, image string, condition string")
    b = spark.createDataFrame([(1, 9, "Crucial X9 SSD 1TB external", None, "new")], "g int, id int, title string, image string, condition string")
    rows = {r.a_id: r for r in matching.score_pairs(matching.pair_features(a), matching.pair_features(b), ["g"]).collect()}
    assert rows[1].confidence != "REJECTED" and not rows[1].blocked and "Same storage" in rows[1].reasons
    assert rows[2].blocked and rows[2].confidence == "REJECTED" and [c.attribute for c in rows[2].conflicts] == ["storage"]
    pairs = matching.confident_pairs(matching.score_pairs(matching.pair_features(a), matching.pair_features(b), ["g"]), ["g"]).collect()
    assert [(p.a_id, p.b_id) for p in pairs] == [(1, 9)]


def test_override_leaves_the_pinned_candidate(spark):
    c = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "g int, id int")
    pins = spark.createDataFrame([(1, 6)], "g int, pinned_id int")
    assert sorted((r.g, r.id) for r in matching.with_overrides(c, pins, ["g"]).collect()) == [(1, 6), (2, 7)]


def test_guards(spark):
    rows = [("Shirt Black", "Shirt White", True), ("Shirt Black", "Shirt Various Colors", True), ("Card 128GB", "Card 256gb", True), ("Plain thing", "Other", False), ("Cup 40 oz", "Cup 40oz", False), ("Red cap", "Cap color: red / blue", True), ("", None, False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")
    got = df.select("i", guards.variation(F.col("a"), F.col("b"))["conflict"].alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [w for *_, w in rows]
    q = spark.createDataFrame([(3, None, "cup"), (12, None, "12-Pack"), (None, None, "cup"), (0, None, "cup")], "l int, r int, t string").select(guards.quantities(F.col("l"), F.col("r"), F.col("t")).alias("q")).collect()
    assert [r.q.level for r in q] == ["warning", "ok", "ok", "unknown"]


def test_csv_round_trip(spark, tmp_path):
    row = {c: None for c in leads.COLUMNS} | {"captured_at": "t", "sell_title": 'a "b", c\nd', "prime": True, "profitable": False, "alerts": "x; y", "sell_price": 1.5}
    kinds = {"prime": "boolean", "profitable": "boolean", "sell_price": "double"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in row))
    line = df.select(leads.csv_line(df).alias("x")).first().x
    got = next(csv.reader(io.StringIO(line)))
    assert got[1] == row["sell_title"] and got[8] == "yes" and got[18] == "no" and len(got) == 20
    leads.write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith(leads.csv_header() + "\r\n") and text.endswith("\r\n")


def test_urls(spark):
    items = ["https://www.ebay.com/itm/123456789012", "http://m.ebay.co.uk/itm/slug/123456789?x=1", "123456789", " www.ebay.de/itm/123456789 ", "https://example.org/itm/123456789", "https://www.ebay.com/sch/x", "javascript:alert(1)", "ftp://www.ebay.com/itm/123456789", "", None, "free text"]
    df = spark.createDataFrame(list(enumerate(items)), "i int, u string")
    got = [(r.u.item_id, r.u.error) for r in df.select("i", urls.item_url(F.col("u")).alias("u")).orderBy("i").collect()]
    assert [g[0] for g in got[:4]] == ["123456789012", "123456789", "123456789", "123456789"]
    assert [g[1] for g in got[4:]] == ["NOT_EBAY_ITEM", "NOT_EBAY_ITEM", *["INVALID_URL"] * 5]
    ids = ["b08n5wrwnw", "https://www.amazon.com/dp/B08N5WRWNW?th=1", "https://www.amazon.de/gp/product/B08N5WRWNW", "https://www.amazon.com/s?k=x&asin=B08N5WRWNW", "https://example.com/dp/B08N5WRWNW", "", "B08"]
    df = spark.createDataFrame(list(enumerate(ids)), "i int, u string")
    assert [r.x for r in df.select("i", urls.product_id(F.col("u"))["asin"].alias("x")).orderBy("i").collect()] == ["B08N5WRWNW"] * 4 + [None] * 3


def test_queries_by_strategy(spark):
    rows = [
        ("Logitech MX Master 3S Wireless Mouse FREE SHIPPING", "Logitech", None, None, None),
        ("Stanley Quencher", "Stanley", None, None, "012345678905"),
        ("Replacement Filter", None, "HRF-APP1", None, None),
        ("Stainless Steel Water Bottle wow", None, None, None, None),
        ("free shipping wow", None, None, None, None),
        ("Stanley Quencher Tumbler with Handle", "Stanley", None, None, "12345"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, brand string, mpn string, model string, gtin string")
    got = built_query(df).orderBy("i").collect()
    assert [r.strategy for r in got] == ["brand-model", "gtin", "mpn", "keywords", None, "brand-keywords"]
    assert got[0].query == "logitech mx master 3s wireless mouse" and got[1].query == "012345678905" and "hrf" in got[2].query and got[4].error == "NO_QUERY"
    assert all(len(r.fallbacks) <= 2 for r in got)


PAGE = """<div data-asin="B08N5WRWNW"><h2>Good mouse with wheel</h2><a href="/dp/B08N5WRWNW">x</a><s class="strike">$99.00</s><span class="price-whole">19.</span><span class="price-fraction">99</span></div>
<div data-asin="B08N5WRWN1" class="sponsored"><h2>Ad</h2><a href="/x">x</a></div><div data-asin="B08N5WRWN2"><h2>Only struck price</h2><a href="/y">y</a><del>$5.00</del></div>
<div data-asin="B08N5WRWNW"><h2>Good mouse again</h2><a href="/dp/B08N5WRWNW">x</a><span class="offscreen">$18.00</span></div><div data-asin="bad"><h2>Bad id here</h2><a href="/z">z</a></div>"""
ITEM = """<html><head><meta property="og:title" content="OG"><script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"Lamp","brand":{"name":"Sony"},
"offers":{"offers":[{"price":"12.50"},{"price":9}]},"gtin13":"0123456789012","additionalProperty":[{"name":"MPN","value":"A-1"}]}]}</script></head><body><table><tr><td>Color:</td><td>Red</td></tr><tr><td>MPN</td><td>late</td></tr></table></body></html>"""


def test_captured_pages(spark):
    rows = captures.search_pages(spark.createDataFrame([(1, PAGE), (2, None), (3, "<div data-asin")], "page int, html string"), "a").orderBy("position").collect()
    assert [(r.id, r.price, r.reject) for r in rows] == [("B08N5WRWNW", 19.99, None), ("B08N5WRWN1", None, "sponsored"), ("B08N5WRWN2", None, "no-price"), (None, None, "bad-id")]
    counts = captures.parse_counts(captures.search_pages(spark.createDataFrame([(1, PAGE)], "page int, html string"), "a"), "page").first()
    assert (counts.scanned, counts.no_price, counts.bad_id) == (4, 1, 1)
    item = captures.item_pages(spark.createDataFrame([(1, ITEM), (2, "")], "page int, html string")).orderBy("page").collect()
    i = item[0]["item"]
    assert (i.title, i.price, i.brand, i.mpn, i.gtin, i.specifics["color"]) == ("Lamp", 9.0, "Sony", "A-1", "0123456789012", "Red")
    assert item[1]["item"].status == "no-title"


def test_price_text():
    assert captures.usd("US $1,234.50") == 1234.5 and captures.usd("C $15.00") is None and captures.usd("$10.00 to $25.00") == 10.0 and captures.usd(None) is None


def test_pages(spark):
    rows = spark.createDataFrame([("r", 1, "1", None, "b", "t", 1.0), ("r", 2, "1", None, "b", "t", 1.0), ("r", 2, None, None, "b", "t", 1.0), ("r", 3, None, None, "b", "t", 1.0)], "run string, page int, id string, url string, site string, title string, price double")
    assert pages.first_of_each(rows, ["run"], [F.col("page")]).count() == 2
    assert pages.merged(rows, ["run"], [F.col("page")]).count() == 3
    assert pages.merged(rows, ["run"], [F.col("page")], most=2).count() == 2
    tiers = spark.createDataFrame([("q", 1, 0), ("q", 2, 7), ("q", 3, 9)], "run string, tier int, rows int")
    assert tuple(pages.first_tier_with_rows(tiers, ["run"]).first()) == ("q", 2, 7)
    newest = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2)], "key string, run_id int")
    assert pages.newest_runs(newest, ["key"]).count() == 2


PAYLOADS = [("r1", "b", 1, 1, 3, None), ("r1", "b", 1, 2, 3, None), ("r1", "b", 2, 3, 0, None), ("r1", "a", 1, 4, 5, None), ("r1", "a", 2, 5, 0, None), ("r2", "b", 1, 1, 2, None), ("r2", "b", 2, 2, 0, "blocked"), ("r3", "a", 1, 1, 9, None)]
SCHEMA = "run string, site string, page int, ts long, items long, error string"


def _payloads(spark):
    return spark.createDataFrame(PAYLOADS, SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))


def test_run_states_stream_equals_batch(spark, tmp_path):
    batch = {tuple(r) for r in runs.run_states_batch(_payloads(spark)).collect()}
    assert ("r1", "done", "a", 2, 0, 3, 5) in batch and ("r2", "blocked", "b", 1, 0, 2, 0) in batch and ("r3", "searching", "b", 0, 0, 0, 0) in batch
    for n, cut in enumerate((PAYLOADS[:3], PAYLOADS[3:])):
        spark.createDataFrame(cut, SCHEMA).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(_payloads(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = runs.run_states(source, timeout_s=3600).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("states").collect():
        last[r["run"]] = tuple(r)
    assert last["r2"][1] == "blocked" and last["r3"][1] == "searching" and last["r1"][5:] == (3, 5)


def test_error_budget():
    s = runs.fresh()
    for page in range(1, 5):
        s = runs.step(s, "b", page, 0, "parse")
    assert s[0] == 1 and s[2] == 0
    assert runs.step(s, "b", 9, 5, None) == s


def test_greedy_pairs_of_a_long_chain(spark):
    """Edges that wait for one another, more rounds than any fixed number: the same as the sequential choice."""
    from pyspark.sql import functions as F

    from pairwright.operators.matching import greedy_pairs

    n = 70  # edge k joins a(k // 2) and b((k + 1) // 2) and is better than edge k - 1
    rows = [("g", k // 2, (k + 1) // 2, float(k)) for k in range(n)]
    edges = spark.createDataFrame(rows, "g string, a_id long, b_id long, sim double")
    got = {(x.a_id, x.b_id) for x in greedy_pairs(edges, ["g"], [F.desc("sim"), "a_id", "b_id"]).collect()}
    want, free_a, free_b = set(), set(), set()
    for _, a, b, _ in sorted(rows, key=lambda r: -r[3]):
        if a not in free_a and b not in free_b:
            want.add((a, b))
            free_a.add(a)
            free_b.add(b)
    assert got == want
    assert greedy_pairs(edges.limit(0), ["g"], [F.desc("sim")]).count() == 0


def test_odd_json_does_not_stop_a_page():
    from pairwright.sources import captures

    page = lambda data: f'<script type="application/ld+json">{data}</script><h1>Some title</h1>'
    for data in ('{"@graph": 1}', '{"@graph": "x"}', "[" * 100_000, '{"@type": "Product", "name": "N", "additionalProperty": 5}', '{"@type": "Product", "name": "N", "additionalProperty": "x"}', "{", "3", '{"@graph": [1, null]}'):
        assert captures.item_page(page(data))["title"] in ("Some title", "N")
    assert captures.product_node(page('{"@graph": {"@type": "Product", "name": "P"}}'))["name"] == "P"
    one = captures.item_page(page('{"@type": "Product", "name": "N", "additionalProperty": {"name": "UPC", "value": "012345678905"}}'))
    assert one["gtin"] == "012345678905"
    deep = "<div>" * 3000 + "<span class=price>$5.00</span>"
    assert captures.card_price(captures.parse(deep)) == 5.0
    assert captures.card_price(captures.parse("<s><b class=price>$5.00</b></s>")) is None
