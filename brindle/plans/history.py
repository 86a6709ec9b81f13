"""Windows, change history, splits and incremental queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators.history import change_log, fold, keep_last, upsert
from brindle.operators.ledger import Ledger
from brindle.operators.order import ranked
from brindle.plans.base import PR, price_records, query, table
from brindle.session import shared_root

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
FULL = ", ".join(f"{c} desc" for c in ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"])


def _last():
    return [F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")]


@query("win_keep_last", f"select {', '.join(ROW)} from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {FULL}) n from lineitem) where n=1")
def win_keep_last(spark, d):
    return keep_last(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _last()).select(*ROW)


@query("win_first_per_group", "select l_partkey, l_orderkey first_order, l_extendedprice from (select *, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) n from lineitem) where n=1")
def win_first_per_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min_by(F.struct("l_orderkey", "l_extendedprice"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")).alias("f")).select("l_partkey", F.col("f.l_orderkey").alias("first_order"), "f.l_extendedprice")


EVT = "ev as (select event_id, ts, user_id, event_type, case when event_id%7=0 then null else floor(value/20)::bigint end price, case when event_id%5=0 then null else event_type end status from events)"
CHG = EVT + ", mg as (select *, last_value(price ignore nulls) over w mp, last_value(status ignore nulls) over w ms from ev window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)), lg as (select *, lag(ts) over w pt, lag(mp) over w pp, lag(ms) over w ps from mg window w as (partition by user_id order by ts, event_id)), chg as (select user_id, event_id, ts, price, status from lg where pt is null or (price is not null and pp is distinct from price) or (status is not null and ps is distinct from status))"


def events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 20)).alias("price"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("status"))


@query("win_change_log", f"with {CHG} select user_id, event_id, ts, price, status from chg")
def win_change_log(spark, d):
    return change_log(events(spark, d), ["user_id"], ["ts", "event_id"], ["price", "status"]).select("user_id", "event_id", "ts", "price", "status")


@query("win_fold_last", f"with {EVT}, s as (select user_id, event_id, ts, last_value(price ignore nulls) over w price, last_value(status ignore nulls) over w status, count(*) over (partition by user_id) updates, row_number() over (partition by user_id order by ts desc, event_id desc) n from ev window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)) select user_id, price, status, updates from s where n=1")
def win_fold_last(spark, d):
    return fold(events(spark, d), ["user_id"], ["ts", "event_id"], ["price", "status"])


@query("win_rec_log", f"with {EVT}, r as (select user_id, event_id, ts, price, coalesce(price,0)>2 as rec from ev), l as (select *, lag(event_id) over w pe, lag(price) over w pp, lag(rec) over w pr from r window w as (partition by user_id order by ts, event_id)) select user_id, event_id, price, rec from l where pe is null or pp is distinct from price or pr is distinct from rec")
def win_rec_log(spark, d):
    """A recommendation is logged when the price or the flag differs from the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).withColumn("rec", F.coalesce("price", F.lit(0)) > 2)
    e = e.withColumns({"pe": F.lag("event_id").over(w), "pp": F.lag("price").over(w), "pr": F.lag("rec").over(w)})
    return e.where("pe is null or not (pp <=> price) or not (pr <=> rec)").select("user_id", "event_id", "price", "rec")


@query("win_missing_runs", "with m as (select user_id, max(cast(ts as date)) last_seen from events where event_type<>'error' group by 1), r as (select distinct cast(ts as date) run_day from events) select m.user_id, m.last_seen, count(run_day) missing, count(run_day)>=2 as disappeared from m left join r on r.run_day>m.last_seen group by 1,2")
def win_missing_runs(spark, d):
    """Complete runs (days) since a key was last seen. The run table has one row a day; ranks replace a range join."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    runs = e.select("day").distinct().withColumn("n", F.row_number().over(Window.orderBy("day")))
    total = runs.agg(F.max("n").alias("runs"))
    seen = e.where("event_type <> 'error'").groupBy("user_id").agg(F.max("day").alias("last_seen"))
    j = seen.join(runs, seen.last_seen == runs.day).join(F.broadcast(total))
    return j.select("user_id", "last_seen", (F.col("runs") - F.col("n")).cast("long").alias("missing"), (F.col("runs") - F.col("n") >= 2).alias("disappeared"))


@query("stream_terminal", "with l as (select user_id, max_by(event_type, ts) last_type, max(ts) last_ts, count(*) n from events group by 1), t as (select *, timestamp '2024-01-31'-last_ts>=interval 24 hour as expired from l) select user_id, last_type, n, expired, case when last_type='purchase' then 'sold' when expired then 'disappeared' else 'active' end state, case when expired then 0 else 1 end as priority from t")
def stream_terminal(spark, d):
    """Expired keys get the top priority; a terminal state is never overwritten by a time-out."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("last_type"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    expired = F.timestamp_diff("HOUR", F.col("last_ts").cast("timestamp"), F.to_timestamp(F.lit("2024-01-31"))) >= 24
    g = g.withColumn("expired", expired)
    state = F.when(F.col("last_type") == "purchase", "sold").when(F.col("expired"), "disappeared").otherwise("active")
    return g.select("user_id", "last_type", "n", "expired", state.alias("state"), F.when(F.col("expired"), 0).otherwise(1).alias("priority"))


@query("win_round_robin", "select p_partkey, p_type, rn::integer rn from (select *, row_number() over (partition by p_type order by p_retailprice, p_partkey) rn from part) order by rn, p_type")
def win_round_robin(spark, d):
    """The cheapest of each type, then the second cheapest of each, and so on: a range-partitioned sort by (place, type)."""
    rn = F.row_number().over(Window.partitionBy("p_type").orderBy("p_retailprice", "p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_type", rn.alias("rn")).orderBy("rn", "p_type")


@query("win_top2_model", "select p_brand, p_partkey, p_retailprice, n::integer n from (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) n from part) where n<=2")
def win_top2_model(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return table(spark, d, "part").withColumn("n", F.row_number().over(w)).where("n <= 2").select("p_brand", "p_partkey", "p_retailprice", "n")


@query("topk_price_history", "select l_partkey, l_shipdate, l_extendedprice, round_even(l_extendedprice-lag(l_extendedprice) over w,2) delta, (row_number() over w)::integer as place from lineitem window w as (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)")
def topk_price_history(spark, d):
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    li = table(spark, d, "lineitem")
    return li.select("l_partkey", "l_shipdate", "l_extendedprice", F.bround(F.col("l_extendedprice") - F.lag("l_extendedprice").over(w), 2).alias("delta"), F.row_number().over(w).alias("place"))


SPLIT = f"{PR}, g as (select brand||'|'||title grp, count(*) n, max(observed_at) last_at from pr group by 1), k as (select *, row_number() over (order by last_at desc, grp) r, count(*) over () groups from g), sp as (select grp, n, case when r<=floor(groups*0.15) then 'test' when r<=floor(groups*0.15)*2 then 'val' else 'train' end part from k)"


def temporal_split(spark, d, share: float = 0.15):
    """The latest groups are the test set, those before them the validation set; no groups at all give an empty test set."""
    g = price_records(spark, d).groupBy(F.concat_ws("|", "brand", "title").alias("grp")).agg(F.count("*").alias("n"), F.max("observed_at").alias("last_at"))
    k = ranked(g, [F.desc("last_at"), F.asc("grp")], "r", "groups")
    cut = F.floor(F.col("groups") * share)
    return k.select("grp", "n", F.when(F.col("r") <= cut, "test").when(F.col("r") <= cut * 2, "val").otherwise("train").alias("part"))


@query("win_temporal_split", f"with {SPLIT} select part, count(*) n_groups, sum(n)::bigint n_rows, min(grp) first_group from sp group by 1")
def win_temporal_split(spark, d):
    return temporal_split(spark, d).groupBy("part").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.min("grp").alias("first_group"))


_LONG = "list_distinct(list_filter(regexp_split_to_array(lower({}),'[^a-z]+'), lambda x: length(x)>=8))"


@query("split_leak_check", f"""with n as (select count(*) n from benchmark), b as (select distinct unnest({_LONG.format('text')}) w from benchmark), d as (select doc_id, documents.text||coalesce(' '||benchmark.text,'') text from n, documents left join benchmark on doc_id%40=0 and item_id=doc_id//40%n),
t as (select doc_id, unnest({_LONG.format('text')}) w from d) select doc_id, count(*) shared from t join b using (w) group by 1 having count(*)>=5""")
def split_leak_check(spark, d):
    """Documents that share rare words with the benchmark are left out of training. Every fortieth document ends with an item of the benchmark."""
    words = lambda: F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 8)))
    items = table(spark, d, "benchmark")
    n = items.count()
    own = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 40 == 0, F.floor(F.col("doc_id") / 40) % max(1, n)).alias("item_id"))
    docs = own.join(items.select("item_id", F.col("text").alias("tail")), "item_id", "left").select("doc_id", F.concat("text", F.coalesce(F.concat(F.lit(" "), "tail"), F.lit(""))).alias("text"))
    return docs.select("doc_id", words().alias("w")).join(items.select(words().alias("w")).distinct(), "w").groupBy("doc_id").agg(F.count("*").alias("shared")).where("shared >= 5")


@query("split_hash")
def split_hash(spark, d):
    """Seeded split by hash: the same groups at any partitioning."""
    u = F.pmod(F.xxhash64("source", "lang", F.lit(17)), F.lit(100))
    return table(spark, d, "documents").select("doc_id", F.when(u < 70, "train").when(u < 85, "val").otherwise("test").alias("part"))


@query("split_subsample")
def split_subsample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    kept = docs.select("source").distinct().where(F.pmod(F.xxhash64("source", F.lit(3)), F.lit(100)) < 40)
    return docs.join(kept, "source", "left_semi")


@query("upsert_newest", f"with n as (select l_orderkey, l_linenumber, l_shipdate, case when l_quantity>25 then l_extendedprice end price, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {FULL}) n from lineitem) where n=1 and l_returnflag<>'A'), o as (select l_orderkey, l_linenumber, l_shipdate, l_extendedprice price, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {FULL.replace(' desc', '')}) n from lineitem) where n=1 and l_linestatus='F') select coalesce(n.l_orderkey,o.l_orderkey) l_orderkey, coalesce(n.l_linenumber,o.l_linenumber) l_linenumber, coalesce(n.price,o.price) price, coalesce(n.l_suppkey,o.l_suppkey) l_suppkey from n full join o on n.l_orderkey=o.l_orderkey and n.l_linenumber=o.l_linenumber")
def upsert_newest(spark, d):
    li, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    new = keep_last(li, keys, _last()).where("l_returnflag <> 'A'").select(*keys, F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")).alias("price"), "l_suppkey")
    first = [F.asc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")]
    old = keep_last(li, keys, first).where("l_linestatus = 'F'").select(*keys, F.col("l_extendedprice").alias("price"), "l_suppkey")
    return upsert(old, new, keys, ["price", "l_suppkey"])


_HASH = "sha1('v2|'||p_name||'|'||p_brand||'|'||{0})"


@query("incremental_second_run", f"select p_partkey, {_HASH.format('p_size')} input_hash from part where p_partkey%10=3 or p_size%4=0 and p_size<>p_size//8*8")
def incremental_second_run(spark, d):
    """Scoring again takes the new rows and those whose inputs changed: every tenth row was never scored, some had another size at the time."""
    key = lambda size: F.sha1(F.concat_ws("|", F.lit("v2"), "p_name", "p_brand", size.cast("string"))).alias("input_hash")
    p, n = table(spark, d, "part"), F.col("p_size")
    done = p.where("p_partkey % 10 <> 3").select("p_partkey", key(F.when(n % 4 == 0, F.floor(n / 8) * 8).otherwise(n)))
    return p.select("p_partkey", key(n)).join(done, ["p_partkey", "input_hash"], "left_anti")


@query("run_status", "with s as (select o_orderpriority scope, o_orderstatus='P' open from orders) select scope, count(*) tasks, count(*) filter (open) open_tasks, case when count(*) filter (open)=0 then 'complete' when count(*) filter (open)*3<count(*) then 'nearly' else 'partial' end status from s group by 1")
def run_status(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("scope"), (F.col("o_orderstatus") == "P").alias("open"))
    n, k = F.count("*"), F.count_if("open")
    return o.groupBy("scope").agg(n.alias("tasks"), k.alias("open_tasks"), F.when(k == 0, "complete").when(k * 3 < n, "nearly").otherwise("partial").alias("status"))


@query("ledger_days", """with t as (select date_trunc('day', ts)::date as task_day, count(*) n, round_even(sum(value),2) total from events group by 1)
select strftime(task_day,'%Y-%m-%d') task, case when day(task_day)%7=3 then 2 when day(task_day)%11=5 then 3 else 1 end attempts, case when day(task_day)%7<>3 and day(task_day)%11=5 then 'failed' else 'done' end status, case when day(task_day)%7=3 or day(task_day)%11<>5 then n end n, case when day(task_day)%7=3 or day(task_day)%11<>5 then total end total from t""")
def ledger_days(spark, d):
    """Days of the event log as tasks of a ledger, in two runs, the first stopped after a batch. Some days fail once, some always."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("task"), "value")
    tasks = e.groupBy("task").agg(F.count("*").alias("priority"))
    day = F.substring("task", 9, 2).cast("int")

    def work(batch):
        error = F.when((day % 7 == 3) & (F.col("attempt") == 1), "first").when((day % 7 != 3) & (day % 11 == 5), "always")
        return batch.join(e, "task").groupBy("task", "attempt").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 2).alias("total")).select("task", "n", "total", error.alias("error"))

    ledger = Ledger(spark, f"{shared_root(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    ledger.run(tasks, work, size=20, batches=1)
    ledger.run(tasks, work, size=20)
    return ledger.state().join(ledger.results().select("task", "n", "total"), "task", "left")
