import time
import zipfile
from types import SimpleNamespace

import pytest
from pyspark import SparkFiles

from marlstone import shared


def test_cut_and_ship(spark):
    df = shared.materialize(spark.range(10).selectExpr("id", "cast(null AS string) AS nothing"))
    assert df.count() == 10 and df.columns == ["id", "nothing"] and shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared.ship(spark) is spark and shared.ship(spark) is spark
    names = [p for p in spark.sparkContext._python_includes if p.startswith("marlstone-")]
    assert len(names) == 1
    with zipfile.ZipFile(SparkFiles.get(names[0])) as z:
        assert "marlstone/shared.py" in z.namelist()


def test_held_tables(spark):
    made = spark.range(100).selectExpr("id", "rand() AS x")
    kept = shared.hold(made)
    first = sorted(map(tuple, kept.collect()))
    assert sorted(map(tuple, kept.collect())) == first and kept.columns == ["id", "x"]
    assert kept.join(shared.hold(kept).withColumnRenamed("x", "y"), "id").where("x <> y").count() == 0
    shared.ship(spark)
    assert not shared._held and kept.count() == 100


def test_tidy_gives_memory_back(spark):
    machine = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: machine.totalMemory() - machine.freeMemory()
    shared.tidy(spark)
    least = used()
    spark._jvm.java.util.BitSet(1 << 30).set(1)  # 128 MB that nothing refers to
    for _ in range(20):  # py4j tells the JVM a little later
        shared.tidy(spark)
        if used() < least + (64 << 20):
            break
        time.sleep(0.2)
    assert used() < least + (64 << 20)


def test_tidy_trims_the_native_heap(spark, monkeypatch):
    said, trim = [], shared._trim_native
    monkeypatch.setattr(shared, "_trim_native", lambda sc: said.append(trim(sc)))
    shared.tidy(spark)
    assert len(said) == 1 and "trim" in said[0].lower()


def test_written_files_are_dropped(spark):
    import glob

    folder = shared.shared_dir(spark).removeprefix("file:")
    since = shared.written()
    shared.materialize(spark.range(3), "dropped")
    kept = shared.materialize(spark.range(3), "kept")
    shared.drop(since, shared.written() - 1)
    assert not glob.glob(f"{folder}/dropped-*") and glob.glob(f"{folder}/kept-*") and kept.count() == 3


def test_a_cluster_must_name_its_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
