"""The event log run as a stream to its end, or in parts that come in one after the other; each result equals the batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.plans.registry import query
from dyadlake.sources import tables as T
from dyadlake.streaming import events as E
from dyadlake.streaming import keyed as K


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS \"start\", event_type, count(*) n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) cents FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return E.run(spark, f"{d}/events.parquet", lambda s: E.tumbling(s, "1 hour"), "complete")


@query("SELECT strftime(w, '%Y-%m-%d %H:%M') AS \"start\", event_type, count(*) n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) cents FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) w FROM events, (VALUES (0), (1)) v(k)) GROUP BY 1, 2")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return E.run(spark, f"{d}/events.parquet", lambda s: E.sliding(s, "2 hours", "1 hour"), "complete")


@query("SELECT user_id, epoch_us(min(ts)) AS \"start\", count(*) n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END fresh FROM events)) GROUP BY user_id, s")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return E.run(spark, f"{d}/events.parquet", lambda s: E.sessions(s, "6 hours"), "complete")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    return E.run(spark, f"{d}/events.parquet", lambda s: E.first_of_each(s), "append")


#: The log in four parts as it might come in: by quarters of its time, but every fiftieth event only with the last.
_PARTS = """placed AS (SELECT *, least(3, CAST(floor((epoch_us(ts) - lo) * 4 / (hi - lo + 1)) AS INT)) AS own_part FROM events, (SELECT epoch_us(min(ts)) lo, epoch_us(max(ts)) hi FROM events)),
 came AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 3 ELSE own_part END AS part FROM placed),
 marks AS (SELECT (SELECT epoch_ms(max(ts)) - 7200000 FROM came WHERE part < 3) early, (SELECT epoch_ms(max(ts)) - 7200000 FROM came) final),
 accepted AS (SELECT came.*, final FROM came, marks WHERE part < 3 OR early IS NULL OR epoch_us({at}) > early * 1000)"""


def parts(spark: SparkSession, d: str) -> list[DataFrame]:
    events = T.table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = events.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    quarter = F.least(F.lit(3), F.floor((F.col("us") - F.col("lo")) * 4 / (F.col("hi") - F.col("lo") + 1)).cast("int"))
    part = F.when(F.col("event_id") % 50 == 0, 3).otherwise(quarter)
    placed = events.join(F.broadcast(ends)).withColumn("part", part).drop("us", "lo", "hi")
    return [placed.where(F.col("part") == k).drop("part") for k in range(4)]


@query(
    "SELECT strftime(w, '%Y-%m-%d %H:%M') AS \"start\", event_type, count(*) n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) cents FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) w FROM accepted) WHERE epoch_ms(w + INTERVAL 1 HOUR) <= final GROUP BY 1, 2",
    also=_PARTS.format(at="time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR"),
)
def stream_late_parts(spark: SparkSession, d: str) -> DataFrame:
    """Hours that the watermark has closed, from a log in parts with late events: those of hours closed before they came are dropped."""
    return E.arrivals(spark, parts(spark, d), lambda s: E.tumbling(s, "1 hour"))


@query(
    "SELECT user_id, event_id, CAST(sum(coalesce(CAST(round(value * 100) AS BIGINT), 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) rolled FROM accepted WHERE epoch_ms(ts) < final",
    also=_PARTS.format(at="ts"),
)
def stream_rolling20(spark: SparkSession, d: str) -> DataFrame:
    """A user's cents over the last 20 events, in order of time over all parts."""
    cents = F.round(F.col("value") * 100)
    return E.arrivals(spark, parts(spark, d), lambda s: K.in_order(s.withColumn("cents", cents), "user_id", "cents", K.rolling_sum(20), "rolled"))


@query(
    "SELECT user_id // 6 AS seat, event_id, last_value(CASE WHEN event_type = 'purchase' THEN user_id END IGNORE NULLS) OVER (PARTITION BY user_id // 6 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) last_aggressor FROM accepted WHERE epoch_ms(ts) < final",
    also=_PARTS.format(at="ts"),
)
def stream_last_aggressor(spark: SparkSession, d: str) -> DataFrame:
    """Who of a table's six users last acted aggressively before each event."""
    seat, who = F.floor(F.col("user_id") / T.SEATED_USERS), F.when(F.col("event_type") == "purchase", F.col("user_id"))
    return E.arrivals(spark, parts(spark, d), lambda s: K.in_order(s.withColumn("seat", seat).withColumn("who", who), "seat", "who", K.last_before, "last_aggressor"))
