"""Incremental jobs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from spotcheck.sources.staging import on_disk


def deduplicated(logs: DataFrame, time: str = "ts", late: str = "7 days", key: str = "dedup_key") -> DataFrame:
    """Each key once; state is kept for as long as rows may be late."""
    return logs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def airing_counts(logs: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Airings of each channel in windows; later rows are dropped."""
    return logs.withWatermark(time, late).groupBy(F.window(time, every), "channel").agg(F.count("*").alias("n"))


def near_pairs(certs: DataFrame, logs: DataFrame, seconds: int = 5, late: str = "1 hour") -> DataFrame:
    """Candidates of certificates and logs as both arrive: same channel and duration, near in time.

    State is kept by blocks of time too, so that a row is held against those of its block only;
    a certificate near a block's edge stands in both.
    """
    width = 12 * seconds * 1_000_000
    block = lambda ts, by=0: F.floor((F.unix_micros(ts) + by * 1_000_000) / width)
    c = certs.withWatermark("cert_ts", late).withColumn("block", F.explode(F.array_distinct(F.array(block("cert_ts", -seconds), block("cert_ts", seconds))))).alias("c")
    r = logs.withWatermark("log_ts", late).withColumn("block", block("log_ts")).alias("r")
    near = F.expr(f"r.log_ts between c.cert_ts - interval {seconds} seconds and c.cert_ts + interval {seconds} seconds")
    return c.join(r, (F.col("c.account_id") == F.col("r.account_id")) & (F.col("c.channel") == F.col("r.channel")) & (F.col("c.duration") == F.col("r.duration")) & (F.col("c.block") == F.col("r.block")) & near).select("cert_id", "log_id", "cert_ts", "log_ts")


def released_scopes(logs: DataFrame, time: str = "ts", grace: str = "7 days", late: str = "10 minutes") -> DataFrame:
    """Log rows of each scope and day (account_id, channel, scope_end, day, n), once its scope is surely over.

    ``logs`` has ``scope_end``, the last day of the row's scope.  A timer at the end of that
    day and ``grace`` later releases what was counted and forgets it.  A scope is kept by its
    days, so that a busy channel is spread; all its days are released in one batch.  Rows that
    come when the watermark has passed them are dropped.  State lives in RocksDB, which the
    session has to name as its provider of state stores.
    """
    due = F.unix_millis(F.date_add("scope_end", 1).cast("timestamp") + F.expr(f"interval {grace}")).alias("due")
    rows = logs.withWatermark(time, late).select(time, "account_id", "channel", "scope_end", F.to_date(time).alias("day"), due)
    key = ["account_id", "channel", "scope_end", "day"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in key) + ", n bigint"
    return rows.groupBy(*key).transformWithStateInPandas(Release(), schema, "append", "eventTime")


class Release(StatefulProcessor):
    """A count for each key until its timer, which the key's first rows set."""

    def init(self, handle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        n = self.count.get()[0] if self.count.exists() else 0
        for batch in rows:
            if not n and len(batch):
                self.handle.registerTimer(int(batch["due"].iloc[0]))
            n += len(batch)
        self.count.update((n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n = self.count.get()[0]
        self.count.clear()
        yield pd.DataFrame({"account_id": [key[0]], "channel": [key[1]], "scope_end": [key[2]], "day": [key[3]], "n": [n]})

    def close(self) -> None:
        pass


def scope_writer(reconcile: Callable[[DataFrame], DataFrame], path: str, ledger: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch: its scopes are reconciled anew and their partitions overwritten.

    ``ledger`` is a folder of the ids of batches that are written, one for each stream.  A
    batch that comes again after a crash finds its id there and changes nothing; one that
    failed before it was entered writes the same partitions again.
    """

    def batch(df: DataFrame, number: int) -> None:
        files, entry = on_disk(df.sparkSession, f"{ledger}/batch-{number}")
        if files.exists(entry):
            return
        scopes = df.select("account_id", "channel").distinct()
        reconcile(scopes).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("account_id", "channel").parquet(path)
        files.mkdirs(entry)

    return batch


def refresh_scopes(logs: DataFrame, reconcile: Callable[[DataFrame], DataFrame], path: str, ledger: str):
    """A writer that refreshes the scopes of each batch by ``scope_writer``; other scopes stay."""
    return logs.writeStream.foreachBatch(scope_writer(reconcile, path, ledger))
