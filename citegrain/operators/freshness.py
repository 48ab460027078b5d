"""What outside sources sent, kept with its age: when to read again, what an answer changes, which libraries are indexed again.

A snapshot is (key, fetched_at, failed_at, etag, body), one row per source; body is null where nothing was ever read. Time is a column throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain import schemas as C


def _after(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"INTERVAL {int(seconds)} SECONDS")


def read_decisions(requests: DataFrame, snapshot: DataFrame, ttl: int = C.CACHE_SECONDS, backoff: int = C.BACKOFF_SECONDS) -> DataFrame:
    """requests (key, ts, ...) with `action`: `cached` while what is held is younger than ttl; `wait` after a recent failure with nothing held;
    else `fetch`, with the etag where something is held (`if_none_match`)."""
    held = requests.join(snapshot.select("key", "fetched_at", "failed_at", "etag", F.col("body").isNotNull().alias("_held")), "key", "left")
    has = F.coalesce("_held", F.lit(False))
    young = has & (F.col("ts") < _after(F.col("fetched_at"), ttl))
    failed = ~has & (F.col("ts") < _after(F.col("failed_at"), backoff))
    action = F.when(young, "cached").when(F.coalesce(failed, F.lit(False)), "wait").otherwise("fetch")
    return held.select(*requests.columns, action.alias("action"), F.when((action == "fetch") & has, F.col("etag")).alias("if_none_match"))


def take_responses(snapshot: DataFrame, responses: DataFrame) -> DataFrame:
    """The snapshot after responses (key, ts, status, etag, body), at most one per key. 200 replaces what is held, 304 makes it young again, anything
    else is a failure: what is held stays (stale beats none)."""
    new = responses.select("key", "ts", "status", F.col("etag").alias("_etag"), F.col("body").alias("_body"))
    both = snapshot.join(new, "key", "full")
    read = F.coalesce((F.col("status") == 200) & F.col("_body").isNotNull(), F.lit(False))
    good = read | F.coalesce((F.col("status") == 304) & F.col("body").isNotNull(), F.lit(False))
    failed = F.col("ts").isNotNull() & ~good
    return both.select(
        "key",
        F.when(good, F.col("ts")).otherwise(F.col("fetched_at")).alias("fetched_at"),
        F.when(failed, F.col("ts")).otherwise(F.col("failed_at")).alias("failed_at"),
        F.when(read, F.col("_etag")).otherwise(F.col("etag")).alias("etag"),
        F.when(read, F.col("_body")).otherwise(F.col("body")).alias("body"),
    )


def cooling(requests: DataFrame, refusals: DataFrame, cooldown: int = C.COOLDOWN_SECONDS) -> DataFrame:
    """requests (key, ts, ...) with `blocked`: a refusal (key, ts) for want of quota came at most `cooldown` seconds before. Both are sorted together
    by hour, with an hour's last refusal carried on, so a busy key is not one task's."""
    hours = cooldown // 3600 + 1
    hour = F.date_trunc("hour", "ts").cast("timestamp")
    own = refusals.select("key", "ts", hour.alias("_hour"))
    last = own.groupBy("key", "_hour").agg(F.max("ts").alias("_ts"))
    carried = last.select("key", "_ts", F.explode(F.array(*[F.col("_hour") + F.expr(f"INTERVAL {k} HOURS") for k in range(1, hours + 1)])).alias("_hour"))
    carried = carried.groupBy("key", "_hour").agg(F.max("_ts").alias("_earlier"))
    names = requests.columns
    rows = requests.withColumn("_hour", hour).withColumn("_asks", F.lit(1)).withColumn("_ts", F.lit(None).cast(own.schema["ts"].dataType))
    rows = rows.unionByName(own.withColumn("_asks", F.lit(0)).withColumn("_ts", F.col("ts")), allowMissingColumns=True)
    before = F.max("_ts").over(Window.partitionBy("key", "_hour").orderBy("ts", "_asks").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("_same", before).where("_asks = 1").join(carried, ["key", "_hour"], "left")
    recent = F.greatest("_same", "_earlier")
    return placed.select(*names, F.coalesce(F.col("ts") < _after(recent, cooldown), F.lit(False)).alias("blocked"))


def refresh_actions(held: DataFrame, fetched: DataFrame, failed: DataFrame) -> DataFrame:
    """(owner, action) for chunk lists held and fetched (owner, ordinal, chunk_id) and owners whose fetch failed. `keep` what is held if the same chunks
    came in the same order; `index` other ones; nothing came: `clear`, or `keep` where the fetch failed. Lists are compared row by row, never collected."""
    columns = ["owner", "ordinal", "chunk_id"]
    both = held.select(*columns, F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(fetched.select(*columns, F.lit(0).alias("old"), F.lit(1).alias("new")))
    pairs = both.groupBy(*columns).agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    owners = pairs.groupBy("owner").agg(F.max((F.col("old") != F.col("new")).cast("int")).alias("differs"), F.sum("new").alias("came"))
    judged = owners.join(failed.select("owner", F.lit(True).alias("failed")).distinct(), "owner", "left")
    action = F.when(F.col("differs") == 0, "keep").when(F.col("came") > 0, "index").when(F.col("failed"), "keep").otherwise("clear")
    return judged.select("owner", action.alias("action"))
