"""Reports and exports as partitioned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from spotcheck.sources.staging import discard, materialize


def report_sheets(verdicts: DataFrame, logs: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a verification report: all, by status, by channel, by brand, matched and unmatched log rows."""
    from spotcheck.functions.scalars import share_percent, status_label

    full = verdicts.join(logs.select("log_id", "log_date", "air_secs", "advt_theme"), "log_id", "left").withColumn("label", status_label(F.col("status")))
    aired = F.count(F.when(F.col("status").isin("matched", "mismatch", "late_telecast"), 1))

    def by(column: str) -> DataFrame:
        return full.groupBy(column).agg(F.count("*").alias("total"), aired.alias("aired"), share_percent(aired, F.count("*")).alias("percent"))

    used = verdicts.filter("log_id is not null").select("log_id")
    return {
        "full": full,
        "channel_summary": by("channel"),
        "brand_summary": by("brand"),
        "matched_log": logs.join(used, "log_id", "left_semi"),
        "unmatched_log": logs.join(used, "log_id", "left_anti"),
    }


def write_report(sheets: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """A folder for each sheet; the full one is partitioned by status."""
    for name, df in sheets.items():
        writer = df.write.mode("overwrite").format(form)
        (writer.partitionBy("status") if "status" in df.columns else writer).save(f"{path}/{name}")


def export_ordered(df: DataFrame, path: str, order: list[Column]) -> None:
    """CSV files whose rows go on in ``order`` from file to file, numbered from 1 in ``row_number``.

    ``order`` should end in an id.  The rows are dealt to ranges once and written there; a
    window in each range and a table of the sizes of ranges give the numbers, and ranges of
    numbers are the files.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = dealt.withColumn("row_number", own.cast("long")).join(F.broadcast(sizes.select("_part", base.alias("_base"))), "_part")
    numbered = numbered.withColumn("row_number", F.col("row_number") + F.col("_base")).drop("_part", "_base")
    numbered.repartitionByRange("row_number").sortWithinPartitions("row_number").write.option("header", True).csv(path)
    discard(dealt)


def read_ordered(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of ``export_ordered``, and whether each follows the one before it in its file (the first row: the last number of the file before)."""
    rows = spark.read.option("header", True).schema(StructType([*schema.fields, StructField("row_number", LongType())])).csv(path)
    rows = rows.withColumns({"_file": F.input_file_name(), "_at": F.struct("_metadata.file_block_start", F.monotonically_increasing_id())})
    files = rows.groupBy("_file").agg(F.max("row_number").alias("_last"))
    files = files.select("_file", F.lag("_last", 1, 0).over(Window.orderBy("_file")).alias("_before"))
    previous = F.lag("row_number").over(Window.partitionBy("_file").orderBy("_at"))
    out = rows.withColumn("_previous", previous).join(F.broadcast(files), "_file")
    return out.withColumn("in_place", F.col("row_number") == F.coalesce("_previous", "_before") + 1).drop("_file", "_at", "_previous", "_before")
