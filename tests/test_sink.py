"""Committed files: failed and repeated tasks leave nothing."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import sink


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def test_files_are_committed(spark, tmp_path):
    rows = [(f"a{i}", bytes([i] * 9)) for i in range(20)] + [("sub/dir/b.PNG", b"x"), ("empty", b"")]
    sink.save_images(spark.createDataFrame(rows, "name string, content binary").repartition(5), str(tmp_path / "out"))
    want = {(n if n.lower().endswith(".png") else n + ".png"): c for n, c in rows}
    assert files(tmp_path / "out") == want
    sink.save_images(spark.createDataFrame([("later", b"1")], "name string, content binary"), str(tmp_path / "out"))
    assert files(tmp_path / "out") == want | {"later.png": b"1"}


@pytest.mark.parametrize("bad", [("../up", b"1"), ("/abs", b"1"), ("x/../../up", b"1"), ("a0", b"again"), ("nothing", None), ("", b"1")])
def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path, bad):
    out = tmp_path / "out"
    sink.save_images(spark.createDataFrame([("old", b"o")], "name string, content binary"), str(out))
    rows = spark.createDataFrame([(f"a{i}", b"1") for i in range(8)] + [bad], "name string, content binary").repartition(4)
    with pytest.raises(Exception):  # noqa: B017  Spark wraps what a task raises
        sink.save_images(rows, str(out))
    assert files(tmp_path) == {"out/old.png": b"o"}


def test_a_task_that_fails_midway(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 39, F.raise_error("lost")).otherwise(F.lit(b"1")).cast("binary").alias("content"))
    with pytest.raises(Exception):  # noqa: B017
        sink.save_images(rows, str(tmp_path / "out"))
    assert files(tmp_path) == {}


def test_a_task_that_runs_twice(tmp_path):
    """Two attempts write; Spark reports the second one's message alone."""
    w = sink.ImageWriter(str(tmp_path / "out"), ".png")
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([b"1", b"2"])], names=["name", "content"])
    lost = w.write(iter([batch]))
    kept = w.write(iter([batch.slice(0, 1), batch.slice(1)]))
    assert lost.files == kept.files and len(files(tmp_path)) == 4
    w.commit([kept, None])
    assert files(tmp_path) == {"out/a.png": b"1", "out/b.png": b"2"}
