"""Scoring, counting and recent scans on a stream of URL events.

The transformations are the batch ones; only watermark, state and sinks are added here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurewatch.operators.features import url_features
from lurewatch.operators.hybrid import hybrid_score
from lurewatch.operators.rules import rule_hits


def score_urls(urls: DataFrame, layer2: Callable[[DataFrame], DataFrame], url: str = "url") -> DataFrame:
    """Features, rules and hybrid score for a batch or streaming table; ``layer2`` adds that column."""
    return hybrid_score(layer2(rule_hits(url_features(urls, url), url)), url=url)


def verdict_counts(scored: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Verdicts per tumbling event-time window; rows later than the watermark are dropped."""
    return (scored.withWatermark(ts, late).groupBy(F.window(ts, window), "verdict")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "verdict", "n"))


def recent_scans(scored: DataFrame, n: int = 5, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The newest scans. A top-n report: every task keeps n rows and only those meet."""
    return (scored.select(ts, key, F.substring("url", 1, 60).alias("url"), "verdict", "score")
            .orderBy(F.desc(ts), F.desc(key)).limit(n))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop. The file sink is exactly-once with its checkpoint."""
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())


HELD = ["micros", "key", "url", "verdict", "score"]
HELD_TYPES = "micros array<bigint>, key array<bigint>, url array<string>, verdict array<string>, score array<double>"


def hold_newest(scored: DataFrame, n: int = 5, ts: str = "ts", key: str = "event_id", keep: str = "1 day",
                buckets: int = 64) -> DataFrame:
    """Keyed state that holds the newest n scans of every bucket of keys, in the state store.

    Any of the newest n scans is among the newest n of its bucket, so the state is at most ``n * buckets`` rows however
    long the stream runs, and no key is hot unless one event repeats. A scan is recent until a newer one is more than
    ``keep`` ahead: later arrivals than that are dropped by the watermark, and a bucket whose scans have all aged
    out loses its state. Scans without a time or a whole-number key are not held.
    """
    import pandas as pd

    def update(bucket, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        parts = [pd.DataFrame(dict(zip(HELD, state.get)), columns=HELD)] if state.exists else []
        for batch in batches:  # n rows are kept between batches, so memory does not grow with the bucket
            rows = pd.concat([*parts, batch[HELD]])
            parts = [rows.sort_values(["micros", "key"], ascending=False).head(n)]
        held = parts[0]
        state.update(tuple([None if pd.isna(v) else v for v in held[c].tolist()] for c in HELD))
        newest = int(held["micros"].max())
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"bucket": [bucket[0]], "held": [len(held)]})

    rows = (scored.withWatermark(ts, keep).where(F.col(ts).isNotNull() & F.col(key).isNotNull())
            .select(ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(key).cast("bigint").alias("key"),
                    F.substring("url", 1, 60).alias("url"), "verdict", "score")
            .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")))
    return rows.groupBy("bucket").applyInPandasWithState(
        update, "bucket int, held int", HELD_TYPES, "update", "EventTimeTimeout")


def run_recent(stream: DataFrame, checkpoint: str, n: int = 5, ts: str = "ts", key: str = "event_id",
               keep: str = "1 day") -> None:
    """Bring the held scans up to what has arrived. They live in the checkpoint alone; nothing else is written."""
    (hold_newest(stream, n, ts, key, keep).writeStream.format("noop").outputMode("update")
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def held_scans(spark: SparkSession, checkpoint: str, n: int = 5, ts: str = "ts", key: str = "event_id",
               keep: str = "1 day") -> DataFrame:
    """The recent scans of a stream, read from its last committed state; the stream may be running or stopped."""
    state = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    scans = state.select(F.inline(F.arrays_zip(*HELD)))
    rows = scans.select(F.timestamp_micros("micros").alias(ts), F.col("key").alias(key), "url", "verdict", "score")
    newest = rows.agg(F.max(ts).alias("_newest"))  # one row
    return (rows.join(F.broadcast(newest), F.col(ts) > F.col("_newest") - F.expr(f"INTERVAL {keep}")).drop("_newest")
            .orderBy(F.desc(ts), F.desc(key)).limit(n))


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A parquet table, be it a folder or one file, as a stream under a declared schema.

    A streaming path has to be a folder unless it is a pattern, hence the one-letter pattern at its end. Files are taken
    in the order of their modification times, at most ``max_files`` a batch if given.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def read_feed_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one-URL-per-line files as a stream."""
    from lurewatch.sources.urls import clean_feed
    return clean_feed(spark.readStream.text(path))
