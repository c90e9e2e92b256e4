"""Queries of streams with timers, a ledger of batches, and two sides."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spotcheck.plans.registry import query
from spotcheck.plans.reports import run_stream, stream
from spotcheck.sources.projection import certs, logs
from spotcheck.sources.staging import materialize, shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query("""SELECT account_id, channel, scope_end, day, count(*) AS n FROM (SELECT user_id % 4 AS account_id, event_type AS channel, CAST(ts AS DATE) AS day, DATE '2024-01-10' + CAST((CAST(ts AS DATE) - DATE '2024-01-01') // 10 * 10 AS INTEGER) AS scope_end FROM events)
  WHERE scope_end + INTERVAL 8 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def stream_released_scopes(spark, sf_dir):
    """Scopes of ten days, released by their timers a week after their end."""
    from spotcheck.streaming import jobs

    end = F.date_add(F.lit("2024-01-10").cast("date"), F.expr("cast(datediff(ts, date '2024-01-01') div 10 * 10 as int)"))
    rows = stream(spark, sf_dir).withColumns({"account_id": F.expr("user_id % 4"), "scope_end": end})
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run_stream(spark, jobs.released_scopes(rows), "append")
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


@query("SELECT account_id, channel, count(*) AS n, max(log_date) AS latest FROM logs GROUP BY ALL")
def stream_refreshed_scopes(spark, sf_dir):
    """Scopes reconciled as events come in; the first batch comes twice, and finds itself in the ledger."""
    from spotcheck.streaming import jobs

    path = f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}"
    full = logs(spark, sf_dir)

    def reconcile(scopes):
        return full.join(scopes, ["account_id", "channel"], "left_semi").groupBy("account_id", "channel").agg(F.count("*").alias("n"), F.max("log_date").alias("latest"))

    rows = stream(spark, sf_dir).filter("event_id % 10 <> 0").withColumn("account_id", F.expr("user_id % 4"))
    jobs.refresh_scopes(rows, reconcile, f"{path}/rows", f"{path}/ledger").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    # the replay brings other rows, so that it would show
    jobs.scope_writer(lambda scopes: reconcile(scopes).withColumn("n", F.lit(0).cast("bigint")), f"{path}/rows", f"{path}/ledger")(full.select("account_id", "channel"), 0)
    return spark.read.schema("n bigint, latest date, account_id bigint, channel string").parquet(f"{path}/rows").select("account_id", "channel", "n", "latest")


@query("""SELECT k.cert_id, r.log_id FROM certs AS k JOIN logs AS r ON r.account_id = k.account_id AND r.channel = k.channel AND r.duration = k.duration
  AND abs(datediff('day', k.cert_date, r.log_date) * 86400 + r.air_secs - k.air_secs) <= 5""")
def stream_near_pairs(spark, sf_dir):
    """Certificates and airings as two streams, met within five seconds, over midnight too."""
    from spotcheck.streaming import jobs

    at = lambda day: F.timestamp_seconds(F.unix_timestamp(F.col(day).cast("timestamp")) + F.col("air_secs"))
    sides = {"cert": certs(spark, sf_dir).withColumn("cert_ts", at("cert_date")), "log": logs(spark, sf_dir).withColumn("log_ts", at("log_date"))}
    read = {}
    for name, df in sides.items():
        stored = materialize(df.select(f"{name}_id", "account_id", "channel", "duration", f"{name}_ts"))
        read[name] = spark.readStream.schema(stored.schema).parquet(stored._stage_path)
    return run_stream(spark, jobs.near_pairs(read["cert"], read["log"]), "append").select("cert_id", "log_id")
