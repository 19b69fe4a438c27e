"""Files under names of their own: all or none."""

import os

import pytest
from pyspark.sql import functions as F

from pairloom.sources import named


def test_each_row_is_a_file_of_its_name(spark, tmp_path):
    rows = spark.createDataFrame([(f"m_{i}.json", f'{{"i": {i}}}') for i in range(20)] + [("empty.txt", None), ("ü.txt", "é\n")], "name string, content string")
    named.write_named(rows, str(tmp_path / "a"))
    assert sorted(os.listdir(tmp_path / "a")) == sorted([*(f"m_{i}.json" for i in range(20)), "empty.txt", "ü.txt"])
    assert (tmp_path / "a" / "m_7.json").read_text() == '{"i": 7}' and (tmp_path / "a" / "ü.txt").read_text() == "é\n"
    named.write_named(rows.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or not os.listdir(tmp_path / "none")
    named.write_named(spark.createDataFrame([("m_7.json", "new"), ("more", "x")], "name string, content string"), f"file://{tmp_path}/a")
    assert (tmp_path / "a" / "m_7.json").read_text() == "new" and len(os.listdir(tmp_path / "a")) == 23
    named.write_named(spark.createDataFrame([("run/metrics/m.json", "x"), ("run/n", "y")], "name string, content string"), str(tmp_path / "a"))
    assert (tmp_path / "a" / "run" / "metrics" / "m.json").read_text() == "x" and (tmp_path / "a" / "run" / "n").read_text() == "y"
    named.write_named(spark.createDataFrame([("only", "x")], "name string, content string"), str(tmp_path / "a"), overwrite=True)
    assert [f for _, _, found in os.walk(tmp_path / "a") for f in found] == ["only"]


@pytest.mark.parametrize("bad", ["task", "name", "twice"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id")).alias("name"), F.lit("x").alias("content"))
    if bad == "task":
        rows = rows.withColumn("content", F.when(F.col("name") == "f17", F.raise_error(F.lit("lost"))).otherwise("x"))
    elif bad == "name":
        rows = rows.withColumn("name", F.when(F.col("name") == "f17", "../out").otherwise(F.col("name")))
    else:
        rows = rows.withColumn("name", F.when(F.col("name") == "f17", "f1").otherwise(F.col("name")))
    with pytest.raises(Exception):
        named.write_named(rows, str(tmp_path / "a"))
    assert not (tmp_path / "a").exists() or not os.listdir(tmp_path / "a")
    assert not (tmp_path / "out").exists()
