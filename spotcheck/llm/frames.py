"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from spotcheck.sources.staging import discard, materialize, shared_dir  # noqa: F401


def fresh_path(spark: SparkSession) -> str:
    """A folder of its own for files in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` range-partitioned by ``keys`` and written out, with its partition in ``_part``.

    The partitions follow the order of the keys, so ranks and running sums over the whole
    table need one window in each partition and one small table of partition totals.
    A key with very many rows spreads over partitions if a later key tells its rows apart.
    """
    dealt = df.repartitionByRange(width(df), *keys)
    return materialize(dealt.withColumn("_part", F.spark_partition_id()))


def running_totals(df: DataFrame, keys: list[str], totals: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Add exclusive running sums over the whole order of an ``ordered`` table.

    ``totals`` maps new column names to the summed columns; ``by`` restarts the sums for each
    value of further columns (few values).  The table of partition totals has a row for each
    partition and ``by`` value only.
    """
    by = by or []
    inner = Window.partitionBy("_part", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    sums = sums.select("_part", *by, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in totals])
    out = df.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in totals.items()})
    out = out.join(sums, ["_part", *by])
    return out.withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in totals}).drop(*[f"_base_{n}" for n in totals])


#: Groups of more than this share of all rows are joined by broadcast; there are fewer of them than its inverse.
LARGE_GROUP = 1 / 4096


def join_by_group(rows: DataFrame, groups: DataFrame, *keys: str, count: str = "rows") -> DataFrame:
    """``rows`` with the columns of their group, of which ``groups`` has one row with its number of rows in ``count``.

    Rows of large groups meet them by broadcast and are not shuffled; the number of large
    groups has a fixed bound whatever the data, and every other group is small in its task.
    ``rows`` is read twice, so it should be a written table; ``count`` is dropped.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    large = F.col(count) > F.lit(max(1.0, total * LARGE_GROUP))
    heavy = F.broadcast(groups.filter(large).drop(count))
    few = rows.join(heavy, [*keys])
    rest = rows.join(heavy.select(*keys), [*keys], "left_anti").join(groups.filter(~large).drop(count), [*keys])
    return few.unionByName(rest)


#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 2000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches take no more than ``TEXT_ROWS`` rows.

    Texts are large rows: with Spark's usual 10,000 a batch and its copies in the executor and
    its worker take over 100 MB a task.  A smaller limit of the session stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "10000"))
    if now <= 0 or now > TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df
