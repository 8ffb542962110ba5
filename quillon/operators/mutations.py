"""The mutation log: (seq, op, key, ...), read as a table by latest wins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ResourceExhausted
from ..functions.hashing import shard_of
from .filters import metadata, unexpired

#: Upper bounds of latency buckets in milliseconds; one more holds the rest. Fixed values.
LATENCY_BOUNDS = (0.1, 0.5, 1, 2, 5, 10, 20, 50, 100, 200, 500)


def latest(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The last entry of each key, tombstones too."""
    by = [F.desc(c) for c in (order or ["seq"])]
    return log.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*by))).where("_n = 1").drop("_n")


def live(log: DataFrame, order: list[str] | None = None, as_of: datetime | Column | None = None) -> DataFrame:
    """Entries that are neither deleted nor expired."""
    out = latest(log, order).where(F.col("op") != "delete")
    return out if as_of is None else out.where(unexpired(as_of))


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("key").distinct(), "key", "left_anti")


def with_expiry(df: DataFrame, written: str, ttl_ms: str) -> DataFrame:
    """expires_at = written + ttl; a null or negative ttl never expires."""
    at = F.col(written) + F.make_dt_interval(secs=F.col(ttl_ms).cast("decimal(18,3)") / 1000)
    return df.withColumn("expires_at", F.when(F.col(ttl_ms) >= 0, at))


def remaining_ttl(as_of: datetime | Column, column: str = "expires_at") -> Column:
    """Milliseconds left, at least 0; -1 for rows that never expire."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.unix_millis(F.col(column).cast("timestamp")) - F.unix_millis(at.cast("timestamp"))))


def export(table: DataFrame, filters: dict[str, str] | None = None, as_of: datetime | Column | None = None) -> DataFrame:
    out = table if as_of is None else table.where(unexpired(as_of))
    return out.where(metadata(filters)) if filters else out


def exists(log: DataFrame, key: str, as_of: datetime | Column | None = None) -> bool | None:
    """None if the key was never seen, else whether it is live: not deleted, and not expired at as_of."""
    alive = (F.col("op") != "delete") & (F.lit(True) if as_of is None else unexpired(as_of))
    row = latest(log.where(F.col("key") == key)).select(alive).first()
    return None if row is None else row[0]


def check_capacity(live_now: DataFrame, incoming: DataFrame, num_shards: int, most: int) -> None:
    """New keys must fit into each shard; updates always do. Raises ResourceExhausted."""
    if most <= 0:
        return
    keys = live_now.select("key").union(incoming.select("key")).distinct()
    full = keys.groupBy(shard_of(F.col("key"), num_shards).alias("shard")).count().where(F.col("count") > most).orderBy("shard").first()
    if full is not None:
        raise ResourceExhausted(f"shard {full[0]} would hold {full[1]} of {most} points")


def stats(log: DataFrame, dim: int = 0, order: list[str] | None = None) -> DataFrame:
    """One row: entries, keys seen, live, deleted, stale share of the log, bytes of live vectors."""
    last = latest(log, order).agg(F.count(F.lit(1)).alias("num_keys"), F.count_if(F.col("op") != "delete").alias("num_live"), F.count_if(F.col("op") == "delete").alias("num_deleted"))
    whole = log.agg(F.count(F.lit(1)).alias("num_entries"))
    both = last.crossJoin(F.broadcast(whole))  # one row each
    stale = F.when(F.col("num_entries") > 0, (F.col("num_entries") - F.col("num_live")) / F.col("num_entries")).otherwise(F.lit(0.0))
    return both.select("num_entries", "num_keys", "num_live", "num_deleted", stale.alias("stale_ratio"), (F.col("num_live") * (4 * dim)).alias("vector_bytes"))


def needs_compaction(stale_ratio: float, entries: int, size_bytes: int) -> bool:
    """The thresholds of list maintenance. Fixed values."""
    return stale_ratio > 0.35 or entries > 50_000 or size_bytes > 1 << 20


def latency_histogram(df: DataFrame, column: str, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """(bucket, upper, n): counts by bucket, not cumulative; the last bucket has no upper bound."""
    bucket = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col(column) <= bounds[i], F.lit(i)).otherwise(bucket)
    upper = F.element_at(F.array(*[F.lit(float(b)) for b in bounds], F.lit(None).cast("double")), F.col("bucket") + 1)
    return df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select("bucket", upper.alias("upper"), "n")
