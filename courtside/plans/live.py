"""The streaming path run over what is there; its results equal the batch ones."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.registry import query
from courtside.sources.logs import LOGS, log_rows
from courtside.sources.storage import fresh_path
from courtside.sources.tables import table
from courtside.streaming import days, live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.event_stream(spark, f"{sf_dir}/events.parquet*")


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) prev from events) where prev is null or prev <> event_type")
def live_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.changes(_events(spark, sf_dir)), fresh_path(spark, "changes"))


@query("select distinct event_id, user_id, event_type from events")
def live_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _events(spark, sf_dir)
    return live.drained(live.deduplicated(twice.unionByName(_events(spark, sf_dir))).select("event_id", "user_id", "event_type"), fresh_path(spark, "once"))


@query("select user_id, min(event_id) event_id, arg_min(event_type, event_id) event_type from events group by user_id")
def live_first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frozen record for each key, appended as lines of JSON."""
    return live.drained(live.first_records(_events(spark, sf_dir)), fresh_path(spark, "frozen"), "json")


@query("select date_trunc('day', ts) \"start\", event_type, count(*) n, round(sum(\"value\"), 4) \"value\" from events group by all")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days: the stream's own aggregate over a table that is there as a whole."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.per_window(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes, true) fresh from events), s as (select user_id, ts, sum(cast(fresh as int)) over (partition by user_id order by ts) k from g)
select user_id, min(ts) "start", max(ts) last, count(*) n from s group by user_id, k""")
def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's news ended for half an hour."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query(f"""with {LOGS}, fine as (select distinct match_id from logs where log_type = 12), f as (select match_id, 'log' feed, log_index row_no from logs where log_type = 12),
s as (select user_id // 4 match_id, 'snapshot' feed, event_id row_no from events where event_id % 2 = 0 and user_id // 4 not in (select match_id from fine)) select * from f union all select * from s""")
def preferred_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rally rows of matches whose log has any; the sampled snapshots of all others."""
    rows = log_rows(spark, sf_dir).where("log_type = 12").select("match_id", F.lit("log").alias("feed"), F.col("log_index").alias("row_no"))
    shots = table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.floor(F.col("user_id") / 4).cast("long").alias("match_id"), F.lit("snapshot").alias("feed"), F.col("event_id").alias("row_no"))
    return rows.unionByName(shots.join(rows.select("match_id").distinct(), "match_id", "left_anti"))


@query("""with e as (select user_id, event_id, case when cast(json_extract_string(props, '$.k') as int) >= 5 then 1 else -1 end step from events where event_type = 'click'), t as (select *, sum(step) over (partition by user_id order by event_id) b from e),
h as (select *, b - least(0, min(b) over (partition by user_id order by event_id)) height from t) select user_id, event_id, step, cast(height as bigint) standing from h""", step="int")
def running_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that stand after each row when a negative one takes the latest back: the running sum less its lowest below nought, so each row needs two numbers of state."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id", F.when(F.get_json_object("props", "$.k").cast("int") >= 5, 1).otherwise(-1).alias("step"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = e.withColumn("b", F.sum("step").over(w))
    return t.select("user_id", "event_id", "step", (F.col("b") - F.least(F.lit(0), F.min("b").over(w))).alias("standing"))


_STEP = "case when event_type <> 'click' then 0 when cast({k} as int) >= 5 then 1 else -1 end"


@query(f"""with e as (select user_id, event_id, ts, {_STEP.format(k="json_extract_string(props, '$.k')")} step, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minutes, true) fresh from events),
d as (select *, sum(cast(fresh as int)) over (partition by user_id order by ts, event_id) day_no from e), b as (select *, sum(step) over (partition by user_id, day_no order by ts, event_id) b from d),
h as (select *, least(0, min(b) over (partition by user_id, day_no order by ts, event_id)) low, max(ts) over () - interval 1 minute seen from b)
select user_id, min(ts) "start", max(ts) last, count(*) n, cast(arg_max(b - low, struct_pack(ts := ts, id := event_id)) as bigint) standing from h group by user_id, day_no having max(ts) + interval 30 minutes <= any_value(seen)""")
def live_days(spark: SparkSession, sf_dir: str, batches: int = 5) -> DataFrame:
    """Players' days out of a stream in several micro-batches, points taken back in it, each day ended by a timer or the next day; what the watermark has not passed yet is still open.

    The events are dropped in the order of time, as a source would, each drop as many files as its size asks for, and the stream goes on from where it
    stopped with each drop: a drop is a micro-batch.
    """
    days.use_rocksdb(spark)
    e = table(spark, sf_dir, "events").withColumn("step", F.expr(_STEP.format(k="get_json_object(props, '$.k')")))
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "step")
    cuts = e.agg(F.percentile_approx(F.col("ts").cast("double"), [k / batches for k in range(1, batches)], 1000).alias("cuts")).first().cuts or []
    path, to, at = fresh_path(spark, "drops"), fresh_path(spark, "days"), F.col("ts").cast("double")
    for low, high in zip([None, *cuts], [*cuts, None]):  # where the upper cut is None it is the last drop
        part = e.where((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True)))
        part.hint("rebalance").write.mode("append").parquet(path)
        out = live.drained(days.days(spark.readStream.schema(e.schema).parquet(path)), to, more=high is not None)
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n", "standing")
