"""Runs as a stream: page payloads update one state for each run (W1-W9, W15), and the batch twin.

A payload is a row (run, site, page, ts, items, error). A run reads side b, then side a. A payload counts if it is for
the side that the run waits for and its page is above the last one taken; an empty page or the page limit ends a side;
errors retry up to a budget; a side that is silent for too long times out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAGE_LIMIT, RETRIES, TIMEOUT_S = 5, 4, 45
SIDES = ("b", "a")
STATE = "side int, page int, errors int, items_b long, items_a long, phase string"
OUTPUT = "run string, phase string, side string, page int, errors int, items_b long, items_a long"


def fresh() -> tuple:
    return (0, 0, 0, 0, 0, "searching")


def step(state: tuple, site: str, page: int, items: int, error: str | None, limit: int = PAGE_LIMIT) -> tuple:
    """The state after one payload; what does not align leaves it as it is."""
    side, last, errors, items_b, items_a, phase = state
    if phase != "searching" or site != SIDES[side] or page <= last:
        return state
    if error == "blocked":
        return side, last, errors, items_b, items_a, "blocked"
    if error:
        errors += 1
        if errors < RETRIES:
            return side, last, errors, items_b, items_a, phase
        items = 0  # the side fails; the run goes on
    else:
        errors = 0
    items_b, items_a = items_b + (items if side == 0 else 0), items_a + (items if side == 1 else 0)
    if items and page < limit:
        return side, page, errors, items_b, items_a, phase
    return (1, 0, 0, items_b, items_a, "searching") if side == 0 else (1, page, errors, items_b, items_a, "done")


def _row(run: str, s: tuple) -> pd.DataFrame:
    return pd.DataFrame([{"run": run, "phase": s[5], "side": SIDES[s[0]], "page": s[1], "errors": s[2], "items_b": s[3], "items_a": s[4]}])


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, timeout_s: int) -> Iterator[pd.DataFrame]:
    s = tuple(state.get) if state.exists else fresh()
    if state.hasTimedOut:
        s = (*s[:5], "timeout") if s[5] == "searching" else s
        state.remove()
        yield _row(key[0], s)
        return
    rows = pd.concat(list(frames)).sort_values(["ts", "page"], kind="stable")
    for site, page, items, error in zip(rows.site, rows.page, rows["items"], rows.error, strict=True):
        s = step(s, site, int(page), int(items), None if pd.isna(error) else error)
    state.update(s)
    state.setTimeoutDuration(timeout_s * 1000)
    yield _row(key[0], s)


def run_states(payloads: DataFrame, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """W1, W3-W8 over a stream of payloads: the state of each run that a batch touched or that timed out. update mode."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _update(key, frames, state, timeout_s)

    return payloads.groupBy("run").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_states_batch(payloads: DataFrame) -> DataFrame:
    """The same over a table: the last state of each run. A run's payloads are as many as its pages and retries."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = fresh()
        rows = pdf.sort_values(["ts", "page"], kind="stable")
        for site, page, items, error in zip(rows.site, rows.page, rows["items"], rows.error, strict=True):
            s = step(s, site, int(page), int(items), None if pd.isna(error) else error)
        return _row(key[0], s)

    return payloads.groupBy("run").applyInPandas(fold, OUTPUT)


def deduplicated(payloads: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Payloads that a tab sent twice count once within the watermark."""
    return payloads.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run", "site", "page"])
