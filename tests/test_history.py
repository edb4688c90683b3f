"""Retention of a stored history: old days go, others stay whatever happens in between."""

from datetime import date

from pyspark.sql import functions as F

from netvigil.sources import files, history


def _history(spark, appends=4):
    path = files.scratch_dir(spark, "history-test")
    for part in range(appends):
        rows = [(k * appends + part, f"2024-01-{1 + k % 5:02d} 10:00:00") for k in range(20)]
        files.append_history(spark.createDataFrame(rows, "flow_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")), path)
    return path


def _ids(df):
    return sorted(r["flow_id"] for r in df.select("flow_id").collect())


def test_old_days_go_and_the_rest_is_compacted(spark):
    path = _history(spark)
    want = _ids(spark.read.parquet(path).where("date >= '2024-01-03'"))
    left = history.retain_history(spark, path, date(2024, 1, 3), most_files=2)
    assert _ids(left) == want
    assert history.partitions(spark, path) == {"2024-01-03": 1, "2024-01-04": 1, "2024-01-05": 1}
    assert _ids(history.retain_history(spark, path, date(2024, 1, 3), most_files=2)) == want


def test_crash_between_any_two_steps(spark, monkeypatch):
    path = _history(spark)
    want = _ids(spark.read.parquet(path).where("date >= '2024-01-02'"))
    real, calls = history._fs, []

    class Crash(Exception):
        pass

    for at in range(1, 40, 3):  # the next run starts where the last one broke
        calls.clear()

        def counted(*a, limit=at):
            calls.append(a)
            if len(calls) > limit:
                raise Crash
            return real(*a)

        monkeypatch.setattr(history, "_fs", counted)
        try:
            history.retain_history(spark, path, date(2024, 1, 2), most_files=2)
        except Crash:
            pass
    monkeypatch.setattr(history, "_fs", real)
    assert _ids(history.retain_history(spark, path, date(2024, 1, 2), most_files=2)) == want


def test_unfinished_rewrite_is_removed(spark):
    path = _history(spark, 1)
    spark.range(3).write.parquet(f"{path}/{history.REWRITE}/date=2024-01-01")  # no success marker at its top
    assert len(_ids(history.retain_history(spark, path, date(2024, 1, 1)))) == 20
    assert not history._exists(spark, f"{path}/{history.REWRITE}")
