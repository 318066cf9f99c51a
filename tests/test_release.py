"""Versions of outputs that change all at once."""

import os

import pytest
from pyspark.sql import functions as F

from cytospark import cli
from cytospark.sinks import files
from cytospark.sinks.release import Release, released

from .test_engine import files as inputs  # noqa: F401


def rows(spark, n, prefix="row"):
    return spark.range(n).repartition(3).select(F.concat(F.lit(f"{prefix} "), F.col("id").cast("string")).alias("value"), "id")


def told(spark, folder):
    return {n: (head, [r["value"] for r in df.collect()] if df is not None else None) for n, (head, df) in released(spark, folder).items()}


@pytest.fixture(params=["file", "viewfs"])
def folder(spark, tmp_path, request):
    if request.param == "file":
        return f"file://{tmp_path}/out"
    name = tmp_path.name.replace("_", "-").replace("[", "").replace("]", "").lower()
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./at", f"file://{tmp_path}")
    return f"viewfs://{name}/at/out"


def test_a_release_changes_all_at_once(spark, folder):
    assert released(spark, folder) == {}
    with Release(spark, folder) as out:
        out.write("a", ["head"], rows(spark, 50), ("id",))
        out.write("x/b", ["one", "two"])
        assert released(spark, folder) == {}
        assert len(out.commit()) == 2
    first = {"a": (["head"], [f"row {i}" for i in range(50)]), "b": (["one", "two"], None)}
    assert told(spark, folder) == first
    broken = rows(spark, 9).withColumn("value", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        with Release(spark, folder) as out:
            out.write("a", ["new"], rows(spark, 5), ("id",))
            out.write("b", [], broken)
            out.commit()
    assert told(spark, folder) == first
    with pytest.raises(ValueError, match="twice"):
        with Release(spark, folder) as out:
            out.write("a", [])
            out.write("y/a", [])
    for n in (3, 4, 5):
        with Release(spark, folder) as out:
            out.write("a", [], rows(spark, n), ("id",))
            out.commit()
        assert told(spark, folder) == {"a": ([], [f"row {i}" for i in range(n)])}


def test_versions_before_the_last_go_and_damage_is_seen(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    for n in range(4):
        with Release(spark, at) as out:
            out.write("a", [], rows(spark, n + 1), ("id",))
            out.commit()
    versions = os.listdir(tmp_path / "out" / "versions")
    assert len(versions) == 2 and (tmp_path / "out" / "current").read_text() in versions
    own = tmp_path / "out" / "versions" / (tmp_path / "out" / "current").read_text() / "a"
    part = next(own.glob("part-*"))
    part.write_text(part.read_text() + "more\n")
    with pytest.raises(ValueError, match="differ"):
        released(spark, at)


def test_the_command_line_writes_a_release(spark, inputs, tmp_path):  # noqa: F811
    at, _ = inputs
    run = lambda *more: cli.main(["extract", str(at / "ref.fa"), str(at / "reads.sam"), "-o", str(tmp_path / "o"), "--chg", *more], spark)
    run()
    run("--release", f"file://{tmp_path}/release")
    for name, (head, lines) in told(spark, f"file://{tmp_path}/release").items():
        assert (tmp_path / name).read_text().splitlines() == head + lines and len(lines) > 3


def test_a_cluster_needs_a_shared_folder(spark, tmp_path):
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        files.append_rows(type("Frame", (), {"sparkSession": Session()})(), str(tmp_path / "x"))
