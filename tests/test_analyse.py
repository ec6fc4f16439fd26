"""Analyse runs: the twelve scenarios as literal rows, any cut of a stream, a stream that is stopped and started again, state tables, guards."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pairwright.operators import matching, search
from pairwright.streaming import analyse as A

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).replace(tzinfo=None)
QUERIES = ["Sony WH-1000XM4 Wireless Headphones Black", "sony wh-1000xm4", "sony wireless"]


def it(n, title="Sony WH-1000XM4 Wireless Headphones"):
    return Row(id=f"B{n:09d}", url=None, title=title, price=220.0 + n)


def event(run, seq, kind, token="r1", tab=None, item=None, query=None, page=None, items=None, error=None, queries=None, pages=None, at=None):
    return (run, seq, T0 + dt.timedelta(seconds=seq if at is None else at), kind, token, tab, item, query, page, items, error, queries, pages)


def begun(run, pages=5, queries=QUERIES):
    return [event(run, 1, "analyse", item="295123456789", pages=pages), event(run, 2, "item", tab=7, item="295123456789", queries=queries), event(run, 3, "opened", tab=9)]


def page(run, seq, n, *items, query=0, **more):
    return event(run, seq, "results", tab=9, query=QUERIES[query], page=n, items=list(items), **more)


SCENARIOS = {
    "s1": begun("s1", 2) + [page("s1", 4, 1, it(1), it(2)), page("s1", 5, 2, it(2), it(3))],
    "s2": begun("s2") + [page("s2", 4, 1), page("s2", 5, 1, it(5), query=1), page("s2", 6, 2, query=1)],
    "s3": begun("s3") + [page("s3", 4 + q, 1, query=q) for q in range(3)] + [page("s3", 7, 1, query=2)],
    "s4": begun("s4") + [page("s4", 4, 1, it(1)), page("s4", 5, 2, it(2)), page("s4", 6, 1, it(3))],
    "s5": begun("s5") + [page("s5", 4, 1, error="blocked"), event("s5", 5, "retry"), page("s5", 6, 1, it(9)), page("s5", 7, 2)],
    "s6": begun("s6") + [page("s6", 4, 1), event("s6", 5, "manual", item="B0BV3SBDZP"), event("s6", 6, "results", tab=11, page=1, items=[it(7)])],
    "s7": begun("s7") + [page("s7", 4, 1, it(1), it(4)), page("s7", 5, 2, error="price-parse")],
    "s8": begun("s8") + [page("s8", 4, 1, error="price-parse"), page("s8", 5, 1, it(6)), page("s8", 6, 2, error="price-parse")],
    "s9": begun("s9") + [page("s9", 4, 1, error="price-parse"), page("s9", 5, 1, error="price-parse"), page("s9", 6, 1, it(8), query=1), page("s9", 7, 2, query=1)],
    "s10": begun("s10") + [page("s10", 4 + q, 1, error="no-results-page", query=q) for q in range(3)],
    "s11": begun("s11") + [page("s11", 4, 1, *[it(n) for n in range(16)]), page("s11", 5, 2)],
}
#: The last row of each: phase, code, query, right, right_tab, held, released.
EXPECTED = {
    "s1": ("done", None, 0, "done", None, 3, 3),
    "s2": ("done", None, 1, "done", None, 1, 1),
    "s3": ("error", "NO_AMAZON_RESULTS", 2, "error", None, 0, None),
    "s4": ("done", None, 0, "done", None, 2, 2),
    "s5": ("done", None, 0, "done", None, 1, 1),
    "s6": ("done", None, 0, "done", None, 1, 1),
    "s7": ("done", None, 0, "done", None, 2, 2),
    "s8": ("done", None, 0, "done", None, 1, 1),
    "s9": ("done", None, 1, "done", None, 1, 1),
    "s10": ("error", "NO_AMAZON_RESULTS", 2, "error", None, 0, None),
    "s11": ("done", None, 0, "done", None, 16, 16),
}


def table(spark, rows):
    return spark.createDataFrame(rows, A.EVENT)


def by_run(rows):
    out = {}
    for r in rows:
        out.setdefault(r.run, []).append(r)
    return {k: sorted(v, key=lambda r: (r.seq is None, r.seq or 0)) for k, v in out.items()}


def test_scenarios(spark):
    got = by_run(A.analysed(table(spark, [e for v in SCENARIOS.values() for e in v])).collect())
    last = {k: v[-1] for k, v in got.items()}
    ends = {k: next(r for r in reversed(v) if r.accepted) for k, v in got.items()}
    assert {k: (r.phase, r.code, r.query, r.right, r.right_tab, r.held, r.released and len(r.released)) for k, r in ends.items()} == EXPECTED
    assert not last["s3"].accepted and last["s3"].phase == "error"  # a page after the end
    assert [r.action for r in got["s1"]] == ["open left", "close left, search 0 page 1", None, "search 0 page 2", "close right, settle"]
    assert [x.id for x in ends["s1"].released] == ["B000000001", "B000000002", "B000000003"]
    s2 = {r.seq: r for r in got["s2"]}
    assert (s2[4].phase, s2[4].query, s2[4].action, s2[5].action) == ("searching", 1, "search 1 page 1", "search 1 page 2")
    s5 = {r.seq: r for r in got["s5"]}
    assert (s5[4].phase, s5[4].code, s5[4].right_tab, s5[5].right_tab, s5[5].page, s5[5].held) == ("error", "NO_AMAZON_RESULTS", 9, 9, 1, 0)
    s6 = {r.seq: r for r in got["s6"]}
    assert (s6[5].phase, s6[5].page, s6[5].action) == ("searching", 1, "close right, open B0BV3SBDZP")
    s8 = {r.seq: r for r in got["s8"]}
    assert (s8[4].retried, s8[4].action, s8[4].right_tab, s8[5].retried, s8[5].held, s8[5].page) == (True, "search 0 page 1", 9, False, 1, 2)
    s9 = {r.seq: r for r in got["s9"]}
    assert (s9[5].query, s9[5].retried, s9[5].action, s9[5].right_tab) == (1, False, "search 1 page 1", 9)
    assert sum(r.wait_ms for r in got["s10"]) >= 1600


def test_no_match_of_unrelated_rows(spark):
    """S11 and S12 to their end: what a run releases goes to the matcher; unrelated rows are no match."""
    genuine = "YITAMOTOR 15x6.00-6 Flat Free Lawn Mower Tires on Wheels, 4 Ply Tubeless Replacement for John Deere Riding Mowers"
    decoys = ["USB C Charger Cable 6FT Fast Charging Cord", "Stainless Steel Water Bottle 32oz Insulated", "Garden Hose Splitter 2 Way Brass", "Bike Lock Heavy Duty Combination"] * 3
    for name, extra in (("s11", [it(99, genuine)]), ("s12", [])):
        events = begun(name) + [page(name, 4, 1, *[it(n, t) for n, t in enumerate(decoys)], *extra), page(name, 5, 2)]
        ended = A.analysed(table(spark, events)).where("released is not null")
        right = ended.select("run", F.posexplode("released").alias("rank", "r")).select("run", "rank", "r.*", F.lit(None).cast("int").alias("quantity")).drop("url")
        title = "YITAMOTOR 15x6.00-6 Flat Free Lawn Mower Tires & Wheel Assemblies 4 Ply Pneumatic Front Tires Replacement Fits John Deere, Lawn Tractors"
        left = spark.createDataFrame([(name, "L", title, None, 56.99)], "run string, id string, title string, gtin string, total_price double")
        best = matching.outcome(matching.best_of_n(left, right, ["run"]), ["run"]).collect()
        assert [(r.r_id, r.accepted, r.error_code) for r in best] == ([("B000000099", True, None)] if extra else [(best[0].r_id, False, "LOW_CONFIDENCE")])


def test_control_events(spark):
    rows = (
        begun("cancel") + [event("cancel", 4, "cancel"), page("cancel", 5, 1, it(1))]
        + begun("closed") + [event("closed", 4, "closed", tab=9), event("closed", 5, "closed", tab=9)]
        + begun("again") + [event("again", 4, "analyse", token="r2", item="111111111"), page("again", 5, 1, it(1)), event("again", 6, "item", token="r2", tab=3, item="222222222", queries=["q"])]
        + begun("twice") + [page("twice", 4, 1, it(1)), page("twice", 4, 1, it(1)), page("twice", 5, 3, it(2)), event("twice", 6, "results", tab=8, page=2, items=[it(3)]), event("twice", 7, None), event("twice", 8, "focus")]
        + [event("bad", 1, "analyse", error="not-item"), event("bad", 2, "retry"), event("bad", 3, "manual", item="B0BV3SBDZP")]
        + begun("silent") + [page("silent", 70, 1, it(1)), event("silent", 71, "retry")]
        + begun("end") + begun("none", queries=[None, " "]) + [event("early", 1, "results", page=1, items=[it(1)])]
        + begun("errors", queries=[f"q{k}" for k in range(9)]) + [event("errors", 4 + k, "results", tab=9, page=1, error="odd") for k in range(5)]
    )
    got = by_run(A.analysed(table(spark, rows), until=T0 + dt.timedelta(hours=1)).collect())
    short = lambda run: [(r.seq, r.accepted, r.phase, r.code) for r in got[run]]
    assert short("cancel")[3:] == [(4, True, "idle", None), (5, False, "idle", None)]
    assert short("closed")[3:] == [(4, True, "error", "NO_AMAZON_RESULTS"), (5, False, "error", "NO_AMAZON_RESULTS")]
    assert short("again")[3:] == [(4, True, "fetching", None), (5, False, "fetching", None), (6, False, "fetching", None), (None, True, "error", "TIMEOUT")]
    assert [(r.seq, r.accepted, r.held) for r in got["twice"][3:]] == [(4, True, 1), (5, False, 1), (6, False, 1), (7, False, 1), (8, False, 1), (None, True, 1)]
    assert short("bad") == [(1, True, "error", "NOT_EBAY_ITEM"), (2, False, "error", "NOT_EBAY_ITEM"), (3, True, "error", "ASIN_INVALID")]
    assert [(r.seq, r.phase, r.code) for r in got["silent"]][3:] == [(70, "error", "NO_AMAZON_RESULTS"), (71, "searching", None), (None, "error", "NO_AMAZON_RESULTS"), (None, "error", "NO_AMAZON_RESULTS")]
    assert short("end")[-1] == (None, True, "error", "NO_AMAZON_RESULTS")
    assert short("none")[1][2:] == ("error", "NO_QUERY")
    assert short("early") == [(1, False, "idle", None)]
    assert [r.query for r in got["errors"][3:]] == [1, 2, 3, 4, 4] and short("errors")[-1][2:] == ("error", "NO_AMAZON_RESULTS")
    assert A.analysed(table(spark, [])).collect() == []


def started(spark, folder, out, check):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.readStream.schema(A.EVENT).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "0 seconds")
    return A.analysed(events).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_of_a_stream_equals_the_table_and_a_restart_goes_on(spark, tmp_path, seed):
    """Two micro-batches, a stop, and the rest from the checkpoint."""
    events = sorted((e for v in SCENARIOS.values() for e in v), key=lambda e: (e[1], e[0]))
    r = random.Random(seed)
    cuts = sorted(r.sample(range(1, len(events)), 3))
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    strip = lambda rows: sorted((x.run, x.seq or 0, x.kind, x.accepted, x.phase, x.code or "", x.query, x.page, x.held, x.action or "", len(x.released or [])) for x in rows)
    # a cut of the order of seq, so every micro-batch's rows come at or after the watermark
    for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(events)], strict=True)):
        part = [e for e in events if e[1] in {x[1] for x in events[i:j]} and (k == 0 or e[1] > done)]
        done = max([x[1] for x in part], default=done if k else 0)
        if part:
            table(spark, part).coalesce(1).write.mode("append").parquet(folder)
        if k in (1, 3):
            started(spark, folder, out, check).awaitTermination(120)
    assert strip(spark.read.parquet(out).collect()) == strip(A.analysed(table(spark, events)).collect())


def test_timer_of_a_stream_fails_a_silent_stage(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    table(spark, begun("silent")).coalesce(1).write.parquet(folder)
    started(spark, folder, out, check).awaitTermination(120)
    table(spark, [event("other", 200, "analyse", item="1")]).coalesce(1).write.mode("append").parquet(folder)
    started(spark, folder, out, check).awaitTermination(120)
    table(spark, [event("other", 201, "retry")]).coalesce(1).write.mode("append").parquet(folder)
    started(spark, folder, out, check).awaitTermination(120)
    got = by_run(spark.read.parquet(out).collect())
    assert [(r.kind, r.phase, r.code) for r in got["silent"]][-1] == ("timeout", "error", "NO_AMAZON_RESULTS")


def test_goes_on_from_a_state_table(spark):
    """The first half's states, and a table with fields missing or spoilt, as a start."""
    first, second = [], []
    for v in SCENARIOS.values():
        first += v[:4]
        second += v[4:]
    states = A.last_states(A.analysed(table(spark, first), snapshot=True))
    states = spark.createDataFrame(states.collect(), states.schema)
    strip = lambda rows: sorted((x.run, x.seq, x.phase, x.code or "", x.query, x.page, x.held, x.action or "") for x in rows)
    whole = A.analysed(table(spark, first + second)).collect()
    assert strip(A.analysed(table(spark, second), initial=states).collect()) == strip(x for x in whole if (x.run, x.seq) in {(e[0], e[1]) for e in second})
    rows = [("a", "r1", "searching", "loading", 9, None, None, -4, "sony wh-1000xm4"), ("b", "r1", "searching", "loading", None, 0, None, 99, None), ("c", None, None, None, None, None, None, None, None)]
    old = spark.createDataFrame(rows, "run string, token string, phase string, right string, query int, page int, pages_done int, pages int, search string")
    fixed = {r.run: r for r in A.repaired(old).collect()}
    assert [(fixed[k].phase, fixed[k].query, fixed[k].page, fixed[k].pages_done, fixed[k].pages, fixed[k].plan) for k in "abc"] == [
        ("searching", 0, 1, 0, 5, ["sony wh-1000xm4"]), ("searching", 0, 1, 0, 20, []), ("idle", 0, 1, 0, 5, [])
    ]
    more = [page("a", 4, 1, it(1), query=1), event("b", 4, "results", tab=9, page=1, items=[it(1)])]
    got = {r.run: (r.accepted, r.action, r.held) for r in A.analysed(table(spark, more), initial=old).collect()}
    assert got == {"a": (True, "search 0 page 2", 1), "b": (False, None, 0)}


def test_coherence_guard(spark):
    rows = [("a", "searching", "done", "loading", None), ("b", "searching", "done", "done", "X"), ("c", "fetching", None, None, None), ("d", "done", "done", "done", None), ("e", "odd", None, None, None), ("f", None, "loading", None, None), ("g", "error", "error", "idle", "TIMEOUT")]
    got = {r.run: (r.phase, r.reset, r.code) for r in A.coherent(spark.createDataFrame(rows, "run string, phase string, left string, right string, code string")).collect()}
    assert got == {"a": ("searching", False, None), "b": ("idle", True, None), "c": ("idle", True, None), "d": ("done", False, None), "e": ("idle", True, None), "f": ("idle", True, None), "g": ("error", False, "TIMEOUT")}


def test_query_plan(spark):
    titles = ['Front  Tires Fits John Deere | 3" Centered Hub, 3/4" Bearings (', "(2 Pack) YITAMOTOR Hub", ") [x] hub - ", None, "same", "x" * 249 + " - tail"]
    t = spark.createDataFrame([(i, s, "same" if s == "same" else "q", ["f1", None, "f2", "f3"]) for i, s in enumerate(titles)], "id int, title string, query string, fallbacks array<string>")
    got = [r.queries for r in A.plan_of(t).orderBy("id").collect()]
    assert got == [
        ['Front Tires Fits John Deere | 3" Centered Hub, 3/4" Bearings', "q", "f1"], ["(2 Pack) YITAMOTOR Hub", "q", "f1"], ["[x] hub", "q", "f1"], ["q", "f1"], ["same", "f1"], ["x" * 249, "q", "f1"],
    ]
    built = search.built_query(spark.createDataFrame([("Sony WH-1000XM4 Wireless Noise Canceling Headphones Black", "Sony", None, "WH-1000XM4", None)], "title string, brand string, mpn string, model string, gtin string"))
    plan = A.plan_of(built).first().queries
    assert plan[0] == "Sony WH-1000XM4 Wireless Noise Canceling Headphones Black" and len(plan) >= 2


def test_a_table_needs_no_state_store(spark):
    """Runs of a table are read in order; events sent twice and a silent end count as over a stream."""
    first = SCENARIOS[next(iter(SCENARIOS))]
    df = A.analysed(table(spark, first + first), until=T0 + dt.timedelta(hours=1))
    assert "TransformWithState" not in df._jdf.queryExecution().executedPlan().toString()
    once = A.analysed(table(spark, first), until=T0 + dt.timedelta(hours=1)).collect()
    accepted = lambda rows: [tuple(r) for r in rows if r.accepted]
    assert once and len(df.collect()) == len(once) and accepted(df.collect()) == accepted(once)
