"""Sessions, rate limits and incremental ingest, in batch form and as Structured Streaming queries with the same results.

Time is event time throughout, and `now` is a parameter, so results do not depend on a clock."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrain import schemas as C
from citegrain.functions.text import tokens


def sessions(events: DataFrame, idle: int = C.SESSION_SECONDS) -> DataFrame:
    """(user_id, started, ended, n_events): a session ends `idle` seconds after its last event."""
    grouped = events.groupBy("user_id", F.session_window("ts", f"{idle} seconds").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"))
    return grouped.select("user_id", "started", "ended", "n_events")


def live_sessions(events: DataFrame, now, idle: int = C.SESSION_SECONDS, most: int = C.MOST_SESSIONS) -> DataFrame:
    """(user_id, touched, place): sessions touched within `idle` seconds of `now`, the most recent `most`; the least recent are evicted."""
    touched = events.where(F.col("ts") <= F.lit(now)).groupBy("user_id").agg(F.max("ts").alias("touched"))
    alive = touched.where(F.unix_timestamp(F.lit(now)) - F.unix_timestamp("touched") <= idle)
    # the best `most` of all users: sorted by each task first, so only `most` rows of each meet
    best = alive.orderBy(F.desc("touched"), "user_id").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("touched"), "user_id")))


def rate_limit(requests: DataFrame, hourly: int = C.RATE_HOUR, daily: int = C.RATE_DAY) -> DataFrame:
    """requests (event_id, user_id, ts) with `status`: 429 over the user's hourly limit, 503 over the day's limit for all, else 200. What a user's limit
    refuses does not count for the day.

    A day's place is the number admitted in earlier hours plus the place in the hour, so no task sees a whole day's requests."""
    hour = F.date_trunc("hour", "ts")
    user = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id")
    counted = requests.withColumn("hour", hour).withColumn("minute", F.date_trunc("minute", "ts")).withColumn("n", F.row_number().over(user))
    passed = counted.where(F.col("n") <= hourly)
    minutes = passed.groupBy(F.to_date("hour").alias("day"), "minute").agg(F.count("*").alias("k"))
    earlier = minutes.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("minute", "before")
    place = F.col("before") + F.row_number().over(Window.partitionBy("minute").orderBy("ts", "event_id"))
    numbered = passed.join(earlier, "minute").withColumn("place", place)
    admitted = numbered.select("event_id", "user_id", "ts", F.when(F.col("place") <= daily, 200).otherwise(503).alias("status"))
    return admitted.unionByName(counted.where(F.col("n") > hourly).select("event_id", "user_id", "ts", F.lit(429).alias("status")))


def _folder(spark: SparkSession) -> str:
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    root = root or tempfile.mkdtemp(prefix="citegrain-stream-")
    return f"{root}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a stream of files. A table is one file or a folder of them; a stream reads folders, so one file is picked out of its own."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Run a stream over what is there and give its result: in update mode the last row of each key. Batches are written once each, under
    their number, so a batch that is run again replaces itself."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no batch had rows
        return spark.createDataFrame([], schema)
    out = spark.read.parquet(f"{folder}/out")
    if mode == "append":
        return out.select(*schema.names)
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "_batch").alias("x"))
    return last.select("x.*")


def stream_rate_counts(events: DataFrame, hourly: int = C.RATE_HOUR) -> DataFrame:
    """(user_id, hour, n, refused) over a stream, tolerating events that are a day late."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("hour"), "n", F.greatest(F.col("n") - hourly, F.lit(0)).alias("refused"))


def stream_distinct(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.select(*keys).dropDuplicates(keys)


def stream_document_frequencies(documents: DataFrame) -> DataFrame:
    """(term, df) kept up to date as documents arrive; idf and mean length follow from it at any time."""
    return documents.select(F.explode(F.array_distinct(tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
