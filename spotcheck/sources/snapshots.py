"""Tables whose changes rewrite the partitions they touch and are published by one manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spotcheck.sources.staging import on_disk


def create(df: DataFrame, root: str, by: str) -> int:
    """Write ``df`` as version 1 of the table in ``root``, in partitions of the column ``by``."""
    return _publish(df.sparkSession, root, 0, {"by": by, "schema": json.loads(df.schema.json()), "parts": _written(df, root, by)})


def read(spark: SparkSession, root: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """The rows of a version, the latest by default; of some partitions (folder names) if given.

    A version's files never change, so a reader that has begun goes on with what it saw.
    """
    at = _manifest(spark, root, version or latest(spark, root))
    schema = StructType.fromJson(at["schema"])
    paths = [f"{root}/{where}/{part}" for part, where in sorted(at["parts"].items()) if parts is None or part in parts]
    if not paths:
        return spark.createDataFrame([], schema)
    stored = StructType([*schema.fields, StructField("generation", StringType())])
    return spark.read.schema(stored).option("basePath", root).parquet(*paths).select(schema.names)


def change(spark: SparkSession, root: str, touched: DataFrame | None, edit: Callable[[DataFrame], DataFrame]) -> int:
    """Rewrite the partitions whose values ``touched`` has (all if None) by ``edit``, as the next version.

    ``edit`` gets the rows of those partitions alone, and what it returns takes their place,
    which may lie in other partitions only where these are touched too.  The new files are
    whole before the manifest names them; a job that dies before that leaves the table as it
    was, and of two writers that began at one version the second fails.  ``touched`` is one
    column with a row for each partition at most, as the manifest has.
    """
    began = latest(spark, root)
    at = _manifest(spark, root, began)
    names = set(at["parts"])
    if touched is not None:
        values = touched.select(F.coalesce(F.col(touched.columns[0]).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))).distinct()
        names &= {f"{at['by']}={r[0]}" for r in values.collect()}
    fresh = _written(edit(read(spark, root, began, sorted(names))), root, at["by"]) if names else {}
    strays = set(fresh) & (set(at["parts"]) - names)
    if strays:
        raise ValueError(f"rows moved into partitions that are not touched: {sorted(strays)[:3]}")
    return _publish(spark, root, began, at | {"parts": {p: w for p, w in at["parts"].items() if p not in names} | fresh})


def drop(spark: SparkSession, root: str, keep: Callable[[str], bool]) -> int:
    """The next version has the partitions whose value ``keep`` accepts; no row is read or written."""
    began = latest(spark, root)
    at = _manifest(spark, root, began)
    return _publish(spark, root, began, at | {"parts": {p: w for p, w in at["parts"].items() if keep(p.split("=", 1)[1])}})


def latest(spark: SparkSession, root: str) -> int:
    files, folder = on_disk(spark, f"{root}/versions")
    return max((int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()), default=0) if files.exists(folder) else 0


def _written(df: DataFrame, root: str, by: str) -> dict[str, str]:
    """Write rows as a generation of their own; its partitions by folder name, and where they are."""
    where = f"generation={uuid.uuid4().hex}"
    df.repartition(by).write.partitionBy(by).parquet(f"{root}/{where}")
    files, folder = on_disk(df.sparkSession, f"{root}/{where}")
    return {name: where for name in (f.getPath().getName() for f in files.listStatus(folder)) if "=" in name}


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{version}", wholetext=True).first()[0])


def _publish(spark: SparkSession, root: str, began: int, manifest: dict) -> int:
    """Make ``manifest`` the version after ``began`` by one rename, which fails if that version is there."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    files, draft = on_disk(spark, f"{root}/versions/.draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    _, final = on_disk(spark, f"{root}/versions/{began + 1}")
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), jsc.hadoopConfiguration()).rename(draft, final, how)
    return began + 1
