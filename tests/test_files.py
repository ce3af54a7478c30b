"""Stages: found by content, never read half-written, safe for two writers."""

import shutil

from dyadlake.sources import files
from pyspark.sql import functions as F


def local(path):
    return path.removeprefix("file://")


def test_addressed_stages_follow_plan_inputs_and_build(spark, tmp_path, monkeypatch):
    source, root = f"file://{tmp_path}/in.parquet", f"file://{tmp_path}/stages"
    spark.range(5).write.parquet(source)
    read = lambda: spark.read.parquet(source).withColumn("x", F.col("id") * 2)
    stages = lambda: sorted(p.name for p in (tmp_path / "stages").iterdir())
    assert files.addressed(read(), root).count() == 5 and len(stages()) == 1
    calls = []
    real = files.publish
    monkeypatch.setattr(files, "publish", lambda *a: calls.append(a) or real(*a))
    assert files.addressed(read(), root).count() == 5 and not calls  # found
    assert files.addressed(read(), root, build="2").count() == 5 and len(calls) == 1
    assert files.addressed(read().where("id > 1"), root).count() == 3 and len(calls) == 2
    spark.range(5, 7).write.mode("append").parquet(source)  # a changed input
    assert files.addressed(read(), root).count() == 7 and len(calls) == 3 and len(stages()) == 4
    assert all(s.startswith("stage-") for s in stages())


def test_half_written_stages_are_made_anew(spark, tmp_path):
    root = f"file://{tmp_path}/stages"
    df = spark.range(4)
    files.addressed(df, root)
    (only,) = (tmp_path / "stages").iterdir()
    (only / "_SUCCESS").unlink()
    next(only.glob("part-*.parquet")).unlink()
    assert not files.exists(spark, f"file://{only}")
    assert files.addressed(df, root).count() == 4 and files.exists(spark, f"file://{only}")
    path = f"file://{tmp_path}/named"
    files.stage(df, path)
    (tmp_path / "named" / "_SUCCESS").unlink()
    assert files.stage(spark.range(4), path).count() == 4


def test_of_two_writers_one_is_kept(spark, tmp_path):
    a, b, path = (f"file://{tmp_path}/{k}" for k in ("a", "b", "stage"))
    spark.range(3).write.parquet(a)
    spark.range(3).write.parquet(b)
    assert files.publish(spark, a, path) and not files.publish(spark, b, path)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "a").exists() and not (tmp_path / "b").exists()


def test_once_sees_changed_tables(spark, tmp_path):
    d = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(f"{d}/x.parquet")
    made = []
    make = lambda: made.append(1) or spark.read.parquet(f"{d}/x.parquet")
    assert files.once(spark, "n", d, make).count() == 3 == files.once(spark, "n", d, make).count() and len(made) == 1
    shutil.rmtree(local(f"{d}/x.parquet"))
    spark.range(6).write.parquet(f"{d}/x.parquet")
    assert files.once(spark, "n", d, make).count() == 6 and len(made) == 2
