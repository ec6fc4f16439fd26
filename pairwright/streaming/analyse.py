"""Analyse runs: data and control events in one keyed stream, with typed state and a timer for each run.

A run reads one item page (stage left) and then search pages for it (stage right): idle, fetching, searching, done or error. Events
are rows (run, seq, ts, kind, token, tab, item, query, page, items, error, queries, pages) of the kinds in KINDS. What a
run holds is split by type: a value (stages, page, budgets, deadline), a list of the planned queries, a list of the rows held
so far, a map of the listings among them, and a map of the events already seen, so that an event sent twice counts once.
Rows are held until an event or the end of a plan releases them (settle); a stage that is silent for TIMEOUT_S fails, by the next event's time or by a
timer once the watermark has passed.

The same steps run over a stream (or a table that goes on from a state), with the state in Spark's store, and over a table, whose
runs are read in order, one at a time. A run's events are taken in the order of ts and seq within a
micro-batch, and batches as they come, so any cut of the same order gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pairwright.session import spread

# Limits, and codes by stage and reason.
TIMEOUT_S, HELD_MOST, PAGES, PAGES_MOST, ERRORS_MOST, BROADER_MOST, WAIT_MS, QUERY_MOST, BRACKETS = 60, 1000, 5, 20, 4, 2, 800, 250, 4
CODES = {
    "left:invalid-url": "INVALID_URL", "left:not-item": "NOT_EBAY_ITEM", "left:blocked": "FETCH_FAILED", "left:timeout": "TIMEOUT", "left:no-title": "NO_TITLE",
    "left:parse-failed": "PARSE_FAILED", "left:closed": "FETCH_FAILED", "right:blocked": "NO_AMAZON_RESULTS", "right:timeout": "NO_AMAZON_RESULTS",
    "right:no-results": "NO_AMAZON_RESULTS", "right:parse-failed": "NO_AMAZON_RESULTS", "right:closed": "NO_AMAZON_RESULTS", "right:id-invalid": "ASIN_INVALID",
}

#: Rows of a table's runs that are handed on at once.
OUT_ROWS = 2000

LISTING = "struct<id: string, url: string, title: string, price: double>"
EVENT = f"run string, seq long, ts timestamp, kind string, token string, tab long, item string, query string, page int, items array<{LISTING}>, error string, queries array<string>, pages int"
STATE = (
    "token string, phase string, left string, right string, left_error string, right_error string, left_tab long, right_tab long, item string, code string, query int, "
    "page int, pages_done int, pages int, retried boolean, errors int, manual string, deadline long, held int, n long"
)
OUTPUT = f"run string, seq long, kind string, accepted boolean, action string, wait_ms int, {STATE}, released array<{LISTING}>, plan array<string>, items array<{LISTING}>"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def code_of(stage: str, reason: str) -> str:
    return CODES.get(f"{stage}:{reason}", "FETCH_FAILED")


def clamped_pages(n: int | None) -> int:
    return PAGES if n is None or n < 1 else min(PAGES_MOST, n)


def fresh() -> dict:
    return dict.fromkeys(NAMES) | {"phase": "idle", "left": "idle", "right": "idle", "query": 0, "page": 1, "pages_done": 0, "pages": PAGES, "retried": False, "errors": 0, "held": 0, "n": 0}


class Shelf:
    """The rows that a run holds and its planned queries, in memory; the processor keeps them in Spark's state instead."""

    def __init__(self):
        self.queries: list[str] = []
        self.rows: list[tuple] = []
        self.known: set[str] = set()

    def plan(self) -> list[str]:
        return list(self.queries)

    def set_plan(self, queries: list[str]) -> None:
        self.queries = list(queries)

    def has(self, key: str) -> bool:
        return key in self.known

    def add(self, rows: list[tuple], keys: list[str]) -> None:
        self.rows += rows
        self.known |= set(keys)

    def all(self) -> list[tuple]:
        return list(self.rows)

    def empty(self) -> None:
        self.rows, self.known = [], set()


class Run:
    """One event's effect on a run: s (the value), shelf, and what is to be done outside. Times are microseconds since 1970."""

    def __init__(self, s: dict, shelf, at: int):
        self.s, self.shelf, self.at = s, shelf, at
        self.actions: list[str] = []
        self.wait, self.released = 0, None

    # ---- pieces of transitions

    def reset(self, **kept) -> None:
        self.s |= fresh() | kept | {"n": self.s["n"]}

    def close(self, *stages: str) -> None:
        for stage in stages:
            if self.s[f"{stage}_tab"] is not None:
                self.actions.append(f"close {stage}")
            self.s[f"{stage}_tab"] = None

    def load(self, stage: str, action: str) -> None:
        self.s |= {stage: "loading", f"{stage}_error": None, "deadline": self.at + TIMEOUT_S * 1_000_000}
        self.actions.append(action)

    def fail(self, stage: str, reason: str) -> None:
        """Only a loading stage fails; a blocked one keeps its tab, where the block can be lifted."""
        if self.s[stage] == "loading":
            self.s |= {stage: "error", f"{stage}_error": reason, "deadline": None, "phase": "error", "code": code_of(stage, reason)}
            if reason != "blocked":
                self.close(stage)

    def search(self, page: int, wait: int = 0) -> None:
        self.s["page"] = page
        self.wait += wait
        self.load("right", f"search {self.s['query']} page {page}")

    def empty(self) -> None:
        self.shelf.empty()
        self.s |= {"held": 0, "page": 1, "pages_done": 0}

    def next_query(self) -> None:
        """The next, broader query from its first page with a fresh budget, or the end."""
        if self.s["query"] + 1 >= len(self.shelf.plan()):
            self.fail("right", "no-results")
            return
        self.empty()
        self.s |= {"query": self.s["query"] + 1, "retried": False}
        self.search(1)

    def settle(self) -> None:
        """The rows held are released for matching."""
        self.close("right")
        self.s |= {"right": "done", "deadline": None, "phase": "done", "code": None}
        self.released = self.shelf.all()
        self.actions.append("settle")

    def settle_or_next(self) -> None:
        if self.s["held"]:
            self.settle()
        else:
            self.next_query()

    def hold(self, items) -> None:
        """Rows of listings not held yet, in order, up to the cap; rows without id and url are all new."""
        rows, keys = [], []
        for it in items:
            key = it["id"] or it["url"]
            if key and (key in keys or self.shelf.has(key)):
                continue
            if self.s["held"] + len(rows) >= HELD_MOST:
                break
            rows.append((it["id"], it["url"], it["title"], it["price"]))
            if key:
                keys.append(key)
        self.shelf.add(rows, keys)
        self.s["held"] += len(rows)

    def ours(self, stage: str, tab: int | None) -> bool:
        if self.s[f"{stage}_tab"] is None:
            self.s[f"{stage}_tab"] = tab
            return True
        return tab == self.s[f"{stage}_tab"]

    # ---- kinds of events; each says whether it counted

    def analyse(self, e) -> bool:
        self.close("left", "right")
        self.shelf.empty()
        self.shelf.set_plan([])
        self.reset(token=e["token"], item=e["item"], pages=clamped_pages(e["pages"]))
        if e["error"] or not e["item"]:
            self.s |= {"phase": "error", "code": code_of("left", e["error"] or "invalid-url")}
        else:
            self.s["phase"] = "fetching"
            self.load("left", "open left")
        return True

    def item(self, e) -> bool:
        if self.s["phase"] != "fetching" or self.s["left"] != "loading" or (e["item"] and e["item"] != self.s["item"]) or not self.ours("left", e["tab"]):
            return False
        if e["error"]:
            self.fail("left", e["error"])
            return True
        self.close("left")
        self.s |= {"left": "done", "deadline": None}
        plan = list(dict.fromkeys(q for q in (e["queries"] or []) if q and q.strip()))
        self.shelf.set_plan(plan)
        if not plan:
            self.s |= {"phase": "error", "code": "NO_QUERY"}
            return True
        self.empty()
        self.s |= {"phase": "searching", "query": 0, "retried": False}
        self.search(1)
        return True

    def results(self, e) -> bool:
        s = self.s
        if s["phase"] != "searching" or s["right"] != "loading":
            return False
        plan, page = self.shelf.plan(), e["page"] or 1
        active = plan[max(0, min(s["query"], len(plan) - 1))] if plan else None
        if (active is None and not s["manual"]) or page > s["page"]:
            return False
        if not self.ours("right", e["tab"]):
            return False
        if page < s["page"]:  # W5: sent back to an earlier page, so there are no more
            self.settle_or_next()
            return True
        if e["query"] and active and not s["manual"] and e["query"].strip().lower() != active.lower():
            return False
        s["deadline"] = None
        if e["error"]:
            self.page_failed(e["error"])
            return True
        items = e["items"] or []
        s |= {"retried": False, "errors": 0, "pages_done": max(s["pages_done"], page)}
        self.hold(items)
        if s["manual"]:
            self.settle()
        elif not items:
            self.settle_or_next()
        elif s["held"] >= HELD_MOST or page >= s["pages"]:
            self.settle()
        else:
            self.search(page + 1, WAIT_MS)
        return True

    def page_failed(self, reason: str) -> None:
        """What is held settles; unread prices are read once more; other errors go on to the next query within a budget."""
        s = self.s
        if s["manual"] or reason in ("blocked", "timeout"):
            self.fail("right", reason)
            s["code"] = "NO_AMAZON_RESULTS"
        elif s["held"]:
            self.settle()
        elif reason == "price-parse" and not s["retried"]:
            s["retried"] = True
            self.search(s["page"], WAIT_MS)
        else:
            s["errors"] += 1
            if s["errors"] > ERRORS_MOST:
                self.fail("right", "no-results")
            else:
                self.wait += WAIT_MS
                self.next_query()

    def retry(self, e) -> bool:
        s = self.s
        if s["phase"] == "fetching" or s["left"] == "error":
            if not s["item"]:
                return False
            s |= {"phase": "fetching", "code": None}
            self.load("left", "open left")
            return True
        if s["phase"] == "searching" or s["right"] == "error":
            plan = self.shelf.plan()
            if not plan and not s["manual"]:
                return False
            s |= {"phase": "searching", "code": None, "query": max(0, min(s["query"], len(plan) - 1))}
            if s["manual"]:
                self.load("right", f"open {s['manual']}")
            else:
                self.empty()
                self.search(1)
            return True
        return False

    def manual(self, e) -> bool:
        """The right listing is named; its page alone is read."""
        if self.s["left"] != "done" and not self.s["manual"] or e["error"] or not e["item"]:
            self.s |= {"phase": "error", "code": "ASIN_INVALID"}
            return True
        kept = {k: self.s[k] for k in ("token", "item", "pages", "left_tab", "right_tab")}
        self.reset(**kept, left="done", manual=e["item"], phase="searching")
        self.close("left", "right")
        self.empty()
        self.load("right", f"open {e['item']}")
        return True

    def cancel(self, e) -> bool:
        self.close("left", "right")
        self.shelf.empty()
        self.shelf.set_plan([])
        self.reset()
        return True

    def closed(self, e) -> bool:
        for stage in ("left", "right"):
            if e["tab"] is not None and self.s[f"{stage}_tab"] == e["tab"]:
                if self.s[stage] == "loading":
                    self.s[f"{stage}_tab"] = None
                    self.fail(stage, "closed")
                    return True
                if self.s[f"{stage}_error"] == "blocked":
                    self.s[f"{stage}_tab"] = None
                    return True
        return False

    def opened(self, e) -> bool:
        """The tab that a loading stage was given."""
        stage = "left" if self.s["left"] == "loading" else "right"
        if self.s[stage] != "loading":
            return False
        self.s[f"{stage}_tab"] = e["tab"]
        return True

    def timed_out(self) -> None:
        for stage in ("left", "right"):
            self.fail(stage, "timeout")


#: The kinds of events and what takes them. Others leave a run as it is.
KINDS = {
    "analyse": Run.analyse, "item": Run.item, "results": Run.results, "retry": Run.retry, "manual": Run.manual, "cancel": Run.cancel, "closed": Run.closed,
    "opened": Run.opened,
}


def _out(run: str, seq, kind: str, accepted: bool, r: Run, snapshot: bool) -> Row:
    r.s["n"] += 1
    listings = lambda rows: None if rows is None else [Row(id=a, url=b, title=c, price=d) for a, b, c, d in rows]
    return Row(
        run=run, seq=seq, kind=kind, accepted=accepted, action=", ".join(r.actions) or None, wait_ms=r.wait, **{k: r.s[k] for k in NAMES},
        released=listings(r.released), plan=r.shelf.plan() if snapshot else None, items=listings(r.shelf.all()) if snapshot else None,
    )


def steps(run: str, s: dict, shelf, seen, events: list, until: int | None = None, snapshot: bool = False) -> Iterator[Row]:
    """The rows that events of one run give; s and shelf change in place. seen(event id) says whether it came before."""
    for e in sorted(events, key=lambda e: (e["at"], e["seq"])):
        if seen(e["seq"]):
            continue
        if s["deadline"] is not None and e["at"] >= s["deadline"]:
            r = Run(s, shelf, s["deadline"])
            r.timed_out()
            yield _out(run, None, "timeout", True, r, snapshot)
        r = Run(s, shelf, e["at"])
        known = e["kind"] in KINDS and (e["kind"] == "analyse" or s["token"] is not None and e["token"] in (None, s["token"]))  # W9: an older run's events do not count
        yield _out(run, e["seq"], e["kind"], known and KINDS[e["kind"]](r, e), r, snapshot)
    if until is not None and s["deadline"] is not None and until >= s["deadline"]:
        r = Run(s, shelf, s["deadline"])
        r.timed_out()
        yield _out(run, None, "timeout", True, r, snapshot)


class _Stored:
    """Shelf over Spark's state handles."""

    def __init__(self, plan, rows, known):
        self._plan, self._rows, self._known = plan, rows, known

    def plan(self) -> list[str]:
        return [r[0] for r in self._plan.get()]

    def set_plan(self, queries: list[str]) -> None:
        self._plan.clear()
        if queries:
            self._plan.put([(q,) for q in queries])

    def has(self, key: str) -> bool:
        return self._known.containsKey((key,))

    def add(self, rows: list[tuple], keys: list[str]) -> None:
        if rows:
            self._rows.appendList(rows)
        for key in keys:
            self._known.updateValue((key,), (True,))

    def all(self) -> list[tuple]:
        return [tuple(r) for r in self._rows.get()]

    def empty(self) -> None:
        self._rows.clear()
        self._known.clear()


class Analyse(StatefulProcessor):
    def __init__(self, until: int | None = None, snapshot: bool = False, timers: bool = False):
        self.until, self.snapshot, self.timers = until, snapshot, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", STATE)
        self.known = handle.getMapState("listed", "key string", "held boolean")
        self.done = handle.getMapState("events", "seq long", "seen boolean")
        self.shelf = _Stored(handle.getListState("plan", "query string"), handle.getListState("held", "id string, url string, title string, price double"), self.known)

    def _read(self) -> dict:
        return dict(zip(NAMES, self.value.get(), strict=True)) if self.value.exists() else fresh()

    def _keep(self, s: dict) -> None:
        self.value.update(tuple(s[k] for k in NAMES))
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if s["deadline"] is not None:
                self.handle.registerTimer(s["deadline"] // 1000)

    def _seen(self, seq: int) -> bool:
        if self.done.containsKey((seq,)):
            return True
        self.done.updateValue((seq,), (True,))
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        s = self._read()
        yield from list(steps(key[0], s, self.shelf, self._seen, list(rows), self.until, self.snapshot))
        self._keep(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        s = self._read()
        if s["deadline"] is not None and expiredTimerInfo.getExpiryTimeInMs() >= s["deadline"] // 1000:
            r = Run(s, self.shelf, s["deadline"])
            r.timed_out()
            yield _out(key[0], None, "timeout", True, r, self.snapshot)
            self._keep(s)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802
        s = {k: initialState[k] for k in NAMES}
        self.shelf.set_plan(list(initialState["plan"]))
        items = [(i["id"], i["url"], i["title"], i["price"]) for i in initialState["items"]]
        self.shelf.add(items, [k for i in items if (k := i[0] or i[1])])
        self._keep(s)


def _in_order(batches, schema: pa.Schema, until: int | None, snapshot: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a part of a table, in the order of run, at and seq; one run's state is in memory at a time."""
    run, s, shelf, seen, out = None, None, None, set(), []

    def ready(least: int):
        if len(out) >= least:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()

    def once(seq) -> bool:
        known = seq in seen
        seen.add(seq)
        return known

    def ended():
        if s is not None:
            out.extend(steps(run, s, shelf, once, [], until, snapshot))

    for batch in batches:
        for e in batch.to_pylist():
            if s is None or e["run"] != run:
                ended()
                run, s, shelf = e["run"], fresh(), Shelf()
                seen.clear()
            out.extend(steps(run, s, shelf, once, [e], None, snapshot))
            yield from ready(OUT_ROWS)
    ended()
    yield from ready(1)


def analysed(events: DataFrame, until: datetime | None = None, initial: DataFrame | None = None, snapshot: bool = False) -> DataFrame:
    """A row (OUTPUT) for each event of each run, and for each timeout; `released` holds the rows of a run that settles.

    events: a stream with a watermark on ts (its timers fail silent stages), or a table (then `until`, if given, is the time by which
    silent stages have failed). initial: a state table, repaired() or by last_states(), to go on from. snapshot adds plan and items to every row.
    Null kinds, unknown kinds, events of an older token and repeated seq give no change; an empty table gives no rows.
    """
    by = None if until is None else int(until.timestamp() * 1_000_000)
    rows = events.withColumn("at", F.unix_micros("ts")).select("run", "seq", "ts", "at", "kind", "token", "tab", "item", "query", "page", "items", "error", "queries", "pages")
    if not events.isStreaming and initial is None:  # nothing of a run is kept, so it needs no store: its events are read in order
        rows = spread(rows, "run").sortWithinPartitions("run", "at", "seq")
        schema = to_arrow_schema(StructType.fromDDL(OUTPUT))
        return rows.drop("ts").mapInArrow(lambda batches: _in_order(batches, schema, by, snapshot), OUTPUT)
    grouped = rows.groupBy("run")
    _ = events.sparkSession.streams.active  # executors look for the coordinator of state stores, which a session without a stream has not started yet
    start = None if initial is None else repaired(initial).groupBy("run")
    return grouped.transformWithState(Analyse(by, snapshot, events.isStreaming), OUTPUT, "append", "EventTime" if events.isStreaming else "None", start)


def last_states(rows: DataFrame) -> DataFrame:
    """The state table of rows that analysed(snapshot=True) gave: the last row of each run, with what it holds."""
    return rows.groupBy("run").agg(F.max_by(F.struct(*NAMES, "plan", "items"), "n").alias("s")).select("run", "s.*")


def repaired(states: DataFrame) -> DataFrame:
    """A state table with the fields that an older writer lacked or spoilt put right.

    states: run and any of STATE's fields, plan, items, search (the query of a run without a plan). Counters below their least
    value or null start afresh, the query's index is brought into the plan, held follows the items.
    """
    have = set(states.columns)
    kinds = {f.split()[0]: f.split()[1] for f in STATE.split(", ")}
    got = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    plan = F.filter(F.coalesce(got("plan", "array<string>"), F.array().cast("array<string>")), lambda q: q.isNotNull())
    single = got("search", "string")
    plan = F.when(F.size(plan) > 0, plan).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))
    out = states.select("run", *[got(k, t).alias(k) for k, t in kinds.items()], plan.alias("plan"), F.coalesce(got("items", f"array<{LISTING}>"), F.array().cast(f"array<{LISTING}>")).alias("items"))
    least = lambda c, low: F.when(F.col(c) >= low, F.col(c)).otherwise(low)
    return out.withColumns(
        {
            "phase": F.coalesce("phase", F.lit("idle")), "left": F.coalesce("left", F.lit("idle")), "right": F.coalesce("right", F.lit("idle")),
            "query": F.greatest(F.lit(0), F.least(F.coalesce("query", F.lit(0)), F.size("plan") - 1)), "page": least("page", 1), "pages_done": least("pages_done", 0),
            "pages": F.when(F.col("pages") >= 1, F.least("pages", F.lit(PAGES_MOST))).otherwise(PAGES), "retried": F.coalesce("retried", F.lit(False)),
            "errors": least("errors", 0), "n": least("n", 0), "held": F.size("items"),
        }
    )


def coherent(states: DataFrame) -> DataFrame:
    """A state that claims to work without a loading stage is reset to idle (reset tells which); code and tabs go with it."""
    working = F.col("phase").isin("fetching", "searching")
    loading = F.coalesce(F.col("left") == "loading", F.lit(False)) | F.coalesce(F.col("right") == "loading", F.lit(False))
    known = F.coalesce(F.col("phase").isin("idle", "done", "error", "fetching", "searching"), F.lit(False))
    reset = ~known | (working & ~loading)
    names = [c for c in states.columns if c in ("code", "left_tab", "right_tab", "deadline")]
    out = states.withColumn("reset", reset).withColumns({c: F.when(~F.col("reset"), F.col(c)) for c in names})
    return out.withColumn("phase", F.when(F.col("reset"), "idle").otherwise(F.col("phase")))


def plan_of(listings: DataFrame) -> DataFrame:
    """Adds queries: the listing's own title as a search text, then the built query and its broader ones (T14-T16's columns query and fallbacks)."""
    edge = "[\\s\"'`|,;:\\-–—]+"
    title = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " ")), f"^{edge}|{edge}$", "")
    out = listings.withColumn("_exact", title)
    exact, length = F.col("_exact"), F.length("_exact")
    count = lambda mark: F.length(F.translate(exact, mark, "")) * -1  # the more of a mark, the greater
    opened = F.lit(False)
    closed = F.lit(False)
    for left, right in ("()", "[]", "{}"):
        opened = opened | (exact.endswith(left) & (count(left) > count(right)))
        closed = closed | (exact.startswith(right) & (count(right) > count(left)))
    for _ in range(BRACKETS):  # brackets left open at the end, or closed at the start, are what a cut has left
        out = out.withColumn("_exact", F.when(opened, F.trim(F.substring(exact, F.lit(1), length - 1))).otherwise(exact))
    for _ in range(BRACKETS):
        out = out.withColumn("_exact", F.when(closed, F.trim(F.substring(exact, F.lit(2), length))).otherwise(exact))
    cut = F.when(length > QUERY_MOST, F.regexp_replace(F.substring("_exact", 1, QUERY_MOST), f"{edge}$", "")).otherwise(exact)
    every = F.concat(F.array(F.trim(cut), F.col("query")), F.slice(F.coalesce("fallbacks", F.array().cast("array<string>")), 1, BROADER_MOST))
    return out.withColumn("queries", F.array_distinct(F.filter(every, lambda q: q.isNotNull() & (F.trim(q) != "")))).drop("_exact")
