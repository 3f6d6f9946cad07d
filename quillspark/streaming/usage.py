"""Usage and delivery streams: windowed counts, sessions, first deliveries, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_usage(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and event type: rows and sum of values. Rows later than the watermark are dropped; works on a stream and on a table alike."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    by = e.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Per user: sessions that end after `gap` without an event."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    by = e.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return by.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def first_deliveries(items: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first delivery of every key; keys older than the watermark leave the state, so the state stays bounded. items has a timestamp column ts."""
    return items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_budget(events: DataFrame, budget: float) -> DataFrame:
    """user_id, spent, remaining after every micro-batch: keyed state that survives batches; a user without events for a day is forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent = state.get[0] if state.exists else 0.0
        for pdf in batches:
            spent += float(pdf["value"].fillna(0).sum())
        state.update((spent,))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "spent": [spent], "remaining": [max(0.0, budget - spent)]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, spent double, remaining double", "spent double", "update", GroupStateTimeout.ProcessingTimeTimeout)


#: Buckets of an upsert target: a batch rewrites those its keys fall into.
BUCKETS = 64


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Complete versions of each bucket, oldest first."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(target)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    if system.exists(root):
        for v in system.listStatus(root):
            name = v.getPath().getName()
            if name.startswith("v") and system.exists(fs.Path(v.getPath(), "_SUCCESS")):
                for b in system.listStatus(v.getPath()):
                    if b.getPath().getName().startswith("bucket="):
                        out.setdefault(int(b.getPath().getName()[7:]), []).append(int(name[1:]))
    return {b: sorted(v) for b, v in out.items()}


def current(spark: SparkSession, target: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest rows of an upsert target (older than a version, of some buckets); None if there are none."""
    paths = []
    for b, versions in _versions(spark, target).items():
        fit = [v for v in versions if before is None or v < before]
        if fit and (buckets is None or b in buckets):
            paths.append(f"{target}/v{fit[-1]}/bucket={b}")
    return spark.read.parquet(*paths) if paths else None


def upsert_by_key(target: str, key: str, buckets: int = BUCKETS):
    """A foreachBatch function that keeps the last row of each key in a Parquet folder, in buckets by the key's hash.

    A batch rewrites only the buckets of its keys, as <target>/v<batch id>/bucket=<b>, from the newest complete older
    version of each; a repeated batch gives the same version again, and an interrupted one is never read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("_v", F.lit(1))
        touched = [r.b for r in batch.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b")).distinct().collect()]  # at most `buckets` rows
        old = current(spark, target, batch_id, touched)
        newest = fresh if old is None else fresh.unionByName(old.withColumn("_v", F.lit(0)))
        rest = [c for c in newest.columns if c not in (key, "_v")]
        last = newest.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_v", *rest)).alias("r")).select(key, "r.*") if rest else newest.select(key).distinct()
        last.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v{batch_id}")

    return write


def with_library(items: DataFrame, library: DataFrame, key: str = "norm_key") -> DataFrame:
    """A stream of items with what the library (a table) knows of them: in_library and the id of the first import. The table is read anew for each micro-batch."""
    first = library.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("library_id"))
    return items.join(first, key, "left").withColumn("in_library", F.col("library_id").isNotNull())


def unrepeated(items: DataFrame, key: str = "norm_key", days: int = 30) -> DataFrame:
    """The items of a stream (key, ts) that did not come through within the last `days`, and none that were dismissed: a dismissal (dismissed = 1) closes its key for good.

    State is one row for each key; it is forgotten when the time is over, dismissed keys are kept.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, closed = state.get if state.exists else (None, False)
        rows = []
        for pdf in batches:
            for ts, dismissed in zip(pdf["ts"], pdf["dismissed"]):
                rows.append((ts, int(dismissed or 0)))
        out = []
        for ts, dismissed in sorted(rows):
            at = ts.value // 1000
            if not closed and not dismissed and (last is None or at - last > days * 86_400_000_000):
                out.append((k[0], ts))
                last = at
            closed = closed or bool(dismissed)
        state.update((last if last is not None else 0, closed))
        if not closed and last is not None:
            state.setTimeoutTimestamp(max(last // 1000 + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["norm_key", "ts"])

    rows = items.select(F.col(key).cast("string").alias("norm_key"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("dismissed").cast("int"), F.lit(0)).alias("dismissed")).where("norm_key is not null and ts is not null")
    return rows.withWatermark("ts", "1 day").groupBy("norm_key").applyInPandasWithState(step, "norm_key string, ts timestamp", "last bigint, closed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def fresh_cache(cache: DataFrame, now: Column, days: float, key: str = "query") -> DataFrame:
    """The newest entry of each key (ts) that is at most `days` old at `now`."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400e6
    rest = [c for c in cache.columns if c != key]
    newest = cache.where(age.between(0, days)).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", *[c for c in rest if c != "ts"])).alias("r"))
    return newest.select(key, "r.*")


def split_malformed(lines: DataFrame, schema: str, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(parsed rows, rejects with their text) of JSON lines: a broken line goes to the side and loses no other."""
    parsed = lines.select(text, F.from_json(text, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    good = parsed.where("r is not null and r._broken is null").select("r.*").drop("_broken")
    return good, parsed.where("r is null or r._broken is not null").select(F.col(text).alias("rejected"))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """n, fingerprint: rows and an order-free hash of columns; equal tables have equal ones, so that an index is only rebuilt when its source changed."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("fingerprint"))


def changes_only(progress: DataFrame, key: str, order: str, *watched: str) -> DataFrame:
    """Rows at which any of the watched columns differs from the key's row before."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    now = F.struct(*watched)
    return progress.withColumn("_b", F.lag(now).over(w)).where(~F.col("_b").eqNullSafe(now)).drop("_b")
