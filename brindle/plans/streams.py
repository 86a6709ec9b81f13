"""Streaming queries, run over the stored events and compared with their batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.plans.base import query
from brindle.plans.history import EVT
from brindle.session import shared_root
from brindle.streaming.events import event_stream, run_complete, windowed
from brindle.streaming.state import run_to_table, settled_changes


def _flat(df, key):
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("w_start"), key, "n", F.bround("total", 2).alias("total"))


@query("stream_tumbling", "select date_trunc('day', ts)::timestamp w_start, event_type, count(*) n, round_even(sum(value),2) total from events group by 1,2")
def stream_tumbling(spark, d):
    return _flat(run_complete(windowed(event_stream(spark, d), "tumbling")), "event_type")


@query("stream_sliding", "select (date_trunc('day', ts)-to_days(k))::timestamp w_start, event_type, count(*) n, round_even(sum(value),2) total from events, (select unnest([0,1]) k) group by 1,2")
def stream_sliding(spark, d):
    return _flat(run_complete(windowed(event_stream(spark, d), "sliding")), "event_type")


@query("stream_session", "with g as (select *, case when ts-lag(ts) over (partition by user_id order by ts)<interval 30 minute then 0 else 1 end brk from events), s as (select *, sum(brk) over (partition by user_id order by ts) k from g) select min(ts) w_start, user_id, count(*) n, round_even(sum(value),2) total from s group by user_id, k")
def stream_session(spark, d):
    return _flat(run_complete(windowed(event_stream(spark, d), "session")), "user_id")


#: Days after which an unseen key has disappeared.
TIMEOUT = 2
#: The settled log: events before the watermark (a day behind the last one), merged values beside those of the key's event before.
_LOG = EVT + """, wm as (select epoch_ms(max(ts))-86400000 wm from events), me as (select user_id, event_id, ts, price, status, wm, last_value(price ignore nulls) over w mp, last_value(status ignore nulls) over w ms, lag(ts) over w pt, lead(ts) over w nt
 from ev, wm where epoch_ms(ts)<wm window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)),
pv as (select *, lag(mp) over w pp, lag(ms) over w ps from me window w as (partition by user_id order by ts, event_id))"""
_GAP = f"interval {TIMEOUT} day"


def _log(spark, d):
    e = event_stream(spark, d).select("event_id", "ts", "user_id", F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 20)).alias("price"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("status"))
    root = f"{shared_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return run_to_table(settled_changes(e, "user_id", "event_id", "ts", ["price", "status"], "1 day", TIMEOUT, {"status": ["purchase"]}), f"{root}/log", f"{root}/checkpoint")


@query("stream_change_log", f"with {_LOG} select user_id, event_id, mp price, ms status from pv where pt is null or (price is not null and price is distinct from pp) or (status is not null and status is distinct from ps) or (ts-pt>{_GAP} and ps is distinct from 'purchase')")
def stream_change_log(spark, d):
    """Observations of changed keys, each with the merged values, from keyed state; the log is never read again."""
    return _log(spark, d).where("kind <> 'disappeared'").select("user_id", "event_id", "price", "status")


@query("stream_states", f"""with {_LOG} select user_id, event_id, ts::timestamp at_time, case when pt is null then 'first' when ts-pt>{_GAP} and ps is distinct from 'purchase' then 'returned' else 'changed' end kind, mp price, ms status from pv
 where pt is null or (price is not null and price is distinct from pp) or (status is not null and status is distinct from ps) or (ts-pt>{_GAP} and ps is distinct from 'purchase')
union all select user_id, null, (ts+{_GAP})::timestamp, 'disappeared', mp, ms from pv where ms is distinct from 'purchase' and case when nt is not null then nt-ts>{_GAP} else wm*1000-epoch_us(ts)>{TIMEOUT}*86400000000 end""")
def stream_states(spark, d):
    """First sight, change, disappearance after a silent time and return of every key; a terminal value stands whatever time passes."""
    return _log(spark, d).select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("at_time"), "kind", "price", "status")
