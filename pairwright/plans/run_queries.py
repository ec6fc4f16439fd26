"""Registered queries over runs: the events table replayed as analyse runs, with a twin that folds them in recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.plans.catalogue import query
from pairwright.sources.listings import table
from pairwright.streaming import analyse

#: Each user is a run; of twelve events the first starts it anew and the second brings the item page, the others are what their type says.
#: Gaps of 10 s and 90 s, so that silent stages occur. In words that Spark and DuckDB share; k is a number of the event's own.
_EVENTS = """
select event_id as seq, cast(user_id as varchar(20)) as run, sec,
  case when m = 0 then 'analyse' when m = 1 then 'item' when event_type = 'purchase' then case when k % 3 = 0 then 'closed' else 'retry' end
    when event_type = 'signup' then case when k % 5 = 0 then 'cancel' when k % 5 = 1 then 'manual' when k % 5 = 2 then 'opened' when k % 5 = 3 then 'focus' else 'results' end else 'results' end as kind,
  case when k % 17 = 0 then cast(null as varchar(9)) when k % 19 = 0 and m > 1 then 'old' else concat('t', cast(t as varchar(9))) end as token,
  case when m = 1 then 7 when k % 23 = 0 then 8 else 9 end as tab,
  case when m < 2 then '295123456789' when k % 2 = 0 then 'B0BV3SBDZP' end as item,
  case when k % 9 = 0 then 1 else m - 1 end as page,
  case when event_type = 'error' then 0 else cast(floor(value) as bigint) % 4 end as many,
  case when m = 0 and value < 2 then 'not-item' when m = 1 and value < 3 then 'no-title'
    when m > 1 and event_type = 'error' then case k % 4 when 0 then 'blocked' when 1 then 'price-parse' when 2 then 'no-results-page' else 'odd' end end as error
from (select *, (n - 1) % 12 as m, (n - 1 - (n - 1) % 12) / 12 as t, sum(case when value >= 90 then 90 else 10 end) over (partition by user_id order by n) as sec
  from (select *, cast(substr(props, 7, length(props) - 7) as integer) as k, row_number() over (partition by user_id order by ts, event_id) as n from events))
"""

_SQL = f"""
with recursive ev as materialized (select *, row_number() over (partition by run order by sec, seq) as i from ({_EVENTS})),
st as (
  select run, 0::bigint as i, -1::bigint as seq, false as accepted, null::varchar as token, 'idle' as phase, 'idle' as l, 'idle' as r, null::varchar as le, null::varchar as re, null::int as lt, null::int as rt,
    null::varchar as item, null::varchar as code, 0 as q, 1 as page, false as retried, 0 as errs, null::varchar as man, null::bigint as dl, []::varchar[] as known, 0 as np, null::varchar as released
  from (select distinct run from ev)
  union all
  select run, i, seq, act <> 'ignore',
    case when act like 'start%' then e_token when act = 'cancel' then null else token end,
    case when act = 'start' or act = 'load left' then 'fetching' when act in ('start bad', 'fail left', 'close left', 'fail', 'fail none', 'fail none after error', 'close right', 'manual bad') then 'error'
      when act in ('plan', 'manual', 'restart', 'load manual') then 'searching' when act = 'settle' then 'done' when act = 'cancel' then 'idle' else phase end,
    case when act in ('start', 'load left') then 'loading' when act in ('start bad', 'cancel') then 'idle' when act in ('fail left', 'close left') then 'error' when act in ('plan', 'manual') then 'done' else l end,
    case when act like 'start%' or act = 'cancel' then 'idle' when act in ('plan', 'manual', 'restart', 'load manual', 'advance', 'advance after error', 'again', 'more') then 'loading' when act in ('fail', 'fail none', 'fail none after error', 'close right') then 'error'
      when act = 'settle' then 'done' else r end,
    case when act = 'fail left' then e_error when act = 'close left' then 'closed' when act like 'start%' or act in ('cancel', 'manual', 'load left') then null else le end,
    case when act = 'fail' then e_error when act like 'fail none%' then 'no-results' when act = 'close right' then 'closed' when act like 'start%' or act in ('cancel', 'plan', 'manual', 'restart', 'load manual', 'advance', 'advance after error', 'again', 'more') then null else re end,
    case when act like 'start%' or act in ('cancel', 'fail left', 'plan', 'close left', 'drop left', 'manual') then null when act = 'tab left' then e_tab else lt end,
    case when act like 'start%' or act in ('cancel', 'manual', 'fail none', 'fail none after error', 'settle', 'close right', 'drop right') or (act = 'fail' and e_error not in ('blocked')) then null when act = 'tab right' then e_tab else rt2 end,
    case when act like 'start%' then e_item when act = 'cancel' then null else item end,
    case when act = 'start bad' then 'NOT_EBAY_ITEM' when act = 'fail left' then 'NO_TITLE' when act = 'close left' then 'FETCH_FAILED' when act in ('fail', 'fail none', 'fail none after error', 'close right') then 'NO_AMAZON_RESULTS' when act = 'manual bad' then 'ASIN_INVALID'
      when act in ('start', 'cancel', 'settle', 'load left', 'restart', 'load manual', 'manual') then null else code end,
    case when act like 'start%' or act in ('cancel', 'plan', 'manual') then 0 when act like 'advance%' then q + 1 else q end,
    case when act like 'start%' or act in ('cancel', 'plan', 'manual', 'restart') or act like 'advance%' then 1 when act = 'more' then page + 1 else page end,
    case when act = 'again' then true when act like 'start%' or act in ('cancel', 'plan', 'manual') or act like 'advance%' or good then false else retried end,
    case when act like 'start%' or act in ('cancel', 'manual') or good then 0 when act like '%after error' then errs + 1 else errs end,
    case when act like 'start%' or act = 'cancel' then null when act = 'manual' then e_item else man end,
    case when act in ('start', 'load left', 'plan', 'manual', 'restart', 'load manual', 'again', 'more') or act like 'advance%' then sec + 60 when act in ('ignore', 'manual bad', 'tab left', 'tab right', 'drop left', 'drop right') then dl else null end,
    case when act like 'start%' or act in ('cancel', 'plan', 'manual', 'restart') or act like 'advance%' then [] when good then merged else known end,
    case when act like 'start%' or act = 'cancel' then 0 when act = 'plan' then 3 else np end,
    case when act = 'settle' then array_to_string(case when good then merged else known end, ',') end
  from (select *, case when act0 = 'next' then case when q + 1 >= np then 'fail none' else 'advance' end when act0 = 'next after error' then case when q + 1 >= np then 'fail none after error' else 'advance after error' end else act0 end as act
    from (select *, mine and ours and kind = 'results' and live and e_page = page and e_error is null as good, case when mine and kind = 'results' and live and e_page <= page and rt is null then e_tab else rt end as rt2,
      list_concat(known, list_filter(incoming, lambda x: not list_contains(known, x))) as merged,
      case when not mine then 'ignore'
        when kind = 'analyse' then case when e_error is not null then 'start bad' else 'start' end
        when kind = 'item' then case when phase <> 'fetching' or l <> 'loading' or e_item <> item or lt <> e_tab then 'ignore' when e_error is not null then 'fail left' else 'plan' end
        when kind = 'results' then case when not live or e_page > page or not ours then 'ignore'
          when e_page < page then case when len(known) > 0 then 'settle' else 'next' end
          when e_error is not null then case when man is not null or e_error = 'blocked' then 'fail' when len(known) > 0 then 'settle' when e_error = 'price-parse' and not retried then 'again' when errs >= 4 then 'fail none after error' else 'next after error' end
          when man is not null then 'settle'
          when len(incoming) = 0 then case when len(known) > 0 then 'settle' else 'next' end
          when e_page >= 5 then 'settle' else 'more' end
        when kind = 'retry' then case when (phase = 'fetching' or l = 'error') and item is not null then 'load left' when phase = 'fetching' or l = 'error' then 'ignore'
          when phase = 'searching' or r = 'error' then case when man is not null then 'load manual' when np > 0 then 'restart' else 'ignore' end else 'ignore' end
        when kind = 'manual' then case when l <> 'done' and man is null or e_item is null then 'manual bad' else 'manual' end
        when kind = 'cancel' then 'cancel'
        when kind = 'closed' then case when lt = e_tab and l = 'loading' then 'close left' when lt = e_tab and le = 'blocked' then 'drop left' when rt = e_tab and r = 'loading' then 'close right' when rt = e_tab and re = 'blocked' then 'drop right' else 'ignore' end
        when kind = 'opened' then case when l = 'loading' then 'tab left' when r = 'loading' then 'tab right' else 'ignore' end
        else 'ignore' end as act0
      from (select s.* replace (
            case when late and (s.l = 'loading' or s.r = 'loading') then 'error' else s.phase end as phase, case when late and s.l = 'loading' then 'error' else s.l end as l, case when late and s.r = 'loading' then 'error' else s.r end as r,
            case when late and s.l = 'loading' then 'timeout' else s.le end as le, case when late and s.r = 'loading' then 'timeout' else s.re end as re,
            case when late and s.l = 'loading' then null else s.lt end as lt, case when late and s.r = 'loading' then null else s.rt end as rt,
            case when late and s.l = 'loading' then 'TIMEOUT' when late and s.r = 'loading' then 'NO_AMAZON_RESULTS' else s.code end as code, case when late then null else s.dl end as dl,
            s.i + 1 as i, s.e_seq as seq),
          coalesce(kind = 'analyse' or s.token is not null and (e_token is null or e_token = s.token), false) as mine,
          coalesce(case when late then false else s.phase = 'searching' and s.r = 'loading' end, false) as live, s.rt is null or s.rt = e_tab as ours
        from (select s.*, e.seq as e_seq, e.sec, e.kind, e.token as e_token, e.tab as e_tab, e.item as e_item, e.page as e_page, e.error as e_error, coalesce(e.sec >= s.dl, false) as late,
            list_transform(range(e.many), lambda j: 'B' || (e.seq * 7 + j * 3) % 10) as incoming
          from st s join ev e on e.run = s.run and e.i = s.i + 1) s)))
)
select seq as event_id, accepted, phase, code, q as query, page, len(known) as held, coalesce(released, '') as released from st where i > 0
"""

def run_events(spark, sf_dir: str):
    """The events table as events of analyse runs."""
    e = spark.sql(_EVENTS.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    # another number for each j below 4, so a page repeats nothing
    ids = F.transform(F.when(F.col("many") > 0, F.sequence(F.lit(0), F.col("many").cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.concat(F.lit("B"), ((F.col("seq") * 7 + j * 3) % 10).cast("string")))
    none = F.lit(None)
    items = F.transform(ids, lambda i: F.struct(i.alias("id"), none.cast("string").alias("url"), none.cast("string").alias("title"), none.cast("double").alias("price")))
    plan = F.when(F.col("kind") == "item", F.array(F.lit("first"), F.lit("second"), F.lit("third")))
    return e.select(
        "run", "seq", F.timestamp_seconds("sec").alias("ts"), "kind", "token", F.col("tab").cast("long").alias("tab"), "item", none.cast("string").alias("query"), F.col("page").cast("int").alias("page"),
        items.alias("items"), "error", plan.alias("queries"), F.lit(5).alias("pages"),
    )


@query(_SQL)
def analyse_runs(spark, sf_dir):
    """Every event of every run, what it changed and what it released."""
    rows = analyse.analysed(run_events(spark, sf_dir)).where("seq is not null")
    return rows.select(F.col("seq").alias("event_id"), "accepted", "phase", "code", "query", "page", "held", F.array_join(F.transform(F.coalesce("released", F.array().cast(f"array<{analyse.LISTING}>")), lambda x: x["id"]), ",").alias("released"))
