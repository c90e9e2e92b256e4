import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from spotcheck.sources import snapshots, store

ROW = "id long, day string, dedup_key string, word string"


def test_uploads_leave_the_store_in_its_buckets(spark, tmp_path):
    name = f"store_{uuid.uuid4().hex}"
    rows = spark.range(200).select("id", F.concat(F.lit("2025-01-"), F.lpad(F.expr("id % 9 + 1").cast("string"), 2, "0")).alias("day"), F.concat(F.lit("k"), F.expr("id % 120")).alias("dedup_key"), F.lit("a").alias("word"))
    store.create_store(rows.filter("id < 100"), name, str(tmp_path / "store"), 4)
    head = lambda df, b: tuple(store.upload(df, name, b, "day", ["id"], 4).first())
    # 100..199 have the keys 100..119 once, and 0..79, which are known
    assert head(rows.filter("id >= 100"), "second") == ("second", 100, 20, 80, "2025-01-01", "2025-01-09")
    assert head(rows.filter("id >= 100"), "again") == ("again", 100, 0, 100, "2025-01-01", "2025-01-09")
    assert head(rows.filter("id < 0"), "empty") == ("empty", 0, 0, 0, None, None)
    twice = spark.createDataFrame([(900, "2025-02-01", "new", "late"), (800, "2025-02-01", "new", "early"), (700, None, None, "no key")], ROW)
    assert head(twice, "twice")[1:4] == (3, 2, 1)
    got = spark.table(name)
    assert got.count() == 122 and got.filter("dedup_key = 'new'").first()["word"] == "early"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.append_new(rows.repartition(4, "dedup_key"), spark.table(name).select("dedup_key"), ["id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        stored = plan[plan.index("SortMergeJoin"):].split("FileScan")
        assert "Bucketed: true" in plan
        # the store is the last scan; nothing between the join and it is exchanged
        assert plan.count("Exchange hashpartitioning(dedup_key") == 1, stored
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    store.drop_store(spark, name)


def test_versions_survive_a_crash_and_a_second_writer(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    rows = spark.createDataFrame([(i, f"d{i % 3}" if i % 7 else None, "k", "old") for i in range(30)], ROW)
    seen = lambda **at: {(r["id"], r["day"], r["word"]) for r in snapshots.read(spark, root, **at).collect()}
    assert snapshots.create(rows, root, "day") == 1
    first = seen()
    assert len(first) == 30
    touched = spark.createDataFrame([("d1",), (None,), ("nowhere",)], "day string")
    edit = lambda df: df.filter("id <> 4").withColumn("word", F.lit("new"))

    publish = snapshots._publish
    with monkeypatch.context() as m:  # the job dies when its files are whole and not yet named
        m.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            snapshots.change(spark, root, touched, edit)
    assert seen() == first and snapshots.latest(spark, root) == 1

    old_files = {f for f in snapshots.read(spark, root).inputFiles() if "day=d0" in f or "day=d2" in f}
    assert snapshots.change(spark, root, touched, edit) == 2
    want = {(i, d, "new" if d in ("d1", None) else w) for i, d, w in first if i != 4}
    assert seen() == want and seen(version=1) == first
    assert old_files <= set(snapshots.read(spark, root).inputFiles())  # what was not touched was not written

    with pytest.raises(Exception, match="exist"):  # one that began at version 1 comes second
        publish(spark, root, 1, {"by": "day", "schema": {}, "parts": {}})
    assert seen() == want
    with pytest.raises(ValueError, match="not touched"):
        snapshots.change(spark, root, touched, lambda df: df.withColumn("day", F.lit("d2")))
    assert snapshots.drop(spark, root, lambda value: value == "d0") == 3
    assert {d for _, d, _ in seen()} == {"d0"}
    assert snapshots.drop(spark, root, lambda value: False) == 4
    assert seen() == set() and snapshots.read(spark, root).columns == ["id", "day", "dedup_key", "word"]
    assert snapshots.change(spark, root, touched, edit) == 5


def test_scopes_are_released_a_week_after_their_end(spark, tmp_path):
    from spotcheck.plans.streams import PROVIDER, ROCKS
    from spotcheck.streaming import jobs

    utc = lambda *a: dt.datetime(*a, tzinfo=dt.timezone.utc)
    batches = [[(1, "a", utc(2025, 1, 3, 5)), (1, "a", utc(2025, 1, 3, 6)), (1, "b", utc(2025, 1, 10, 23))], [(1, "a", utc(2025, 1, 17, 12)), (1, "a", utc(2025, 1, 4, 1))], [(1, "a", utc(2025, 1, 18, 12))], [(1, "a", utc(2025, 1, 5, 1)), (1, "c", utc(2025, 1, 18, 13))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "account_id long, channel string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/batch={i}"))
    stream = spark.readStream.schema("account_id long, channel string, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    end = F.date_add(F.lit("2025-01-10").cast("date"), F.expr("cast(datediff(ts, date '2025-01-01') div 10 * 10 as int)"))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = jobs.released_scopes(stream.withColumn("scope_end", end))
        out.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    got = sorted((r["channel"], str(r["day"]), str(r["scope_end"]), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # released when the 18th has passed; the row of the 5th then comes too late, the scope to the 20th is still open
    assert got == [("a", "2025-01-03", "2025-01-10", 2), ("a", "2025-01-04", "2025-01-10", 1), ("b", "2025-01-10", "2025-01-10", 1)]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    from spotcheck.streaming import jobs

    path, ledger = str(tmp_path / "rows"), str(tmp_path / "ledger")
    write = lambda n: jobs.scope_writer(lambda scopes: scopes.withColumn("n", F.lit(n)), path, ledger)
    scopes = lambda *rows: spark.createDataFrame(rows, "account_id long, channel string")
    got = lambda: {(r["channel"], r["n"]) for r in spark.read.parquet(path).collect()}
    write(1)(scopes((1, "a"), (1, "b"), (1, "a")), 0)
    write(2)(scopes((1, "a")), 0)
    assert got() == {("a", 1), ("b", 1)}
    write(3)(scopes((1, "b")), 1)
    assert got() == {("a", 1), ("b", 3)}
    failing = jobs.scope_writer(lambda s: s.withColumn("n", F.expr("cast(raise_error('lost') as int)")), path, ledger)
    with pytest.raises(Exception, match="lost"):
        failing(scopes((1, "a")), 2)
    write(4)(scopes((1, "a")), 2)  # it was not entered, so it is done now
    assert got() == {("a", 4), ("b", 3)}
