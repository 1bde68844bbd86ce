"""Folders of real files: new, known, too new, excluded, changed, gone."""

import os
import time

import pytest
from pyspark.sql import functions as F

from chainloom.sources import folders

NOW = int(time.time())


@pytest.fixture
def tree(tmp_path):
    for name, age in {"a.bin": 100, "b.bin": 10, "sub/c.bin": 100, "sub/skip-d.bin": 100, "skip-sub/e.bin": 100, "sub/deep/f g%.bin": 100, "later.bin": -3600}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * len(name))
        os.utime(p, (NOW - age, NOW - age))
    return str(tmp_path / "root")


def keys(df):
    return sorted(r.key for r in df.collect())


def test_listing(spark, tree):
    got = {r.key: r.length for r in folders.listing(spark, tree, "n", "skip-").collect()}
    assert got == {f"n/{k}": len(k) for k in ("a.bin", "b.bin", "sub/c.bin", "sub/deep/f g%.bin", "later.bin")}
    assert len(keys(folders.listing(spark, tree, "n"))) == 7


def test_to_archive(spark, tree):
    files, now = folders.listing(spark, tree, "n", "skip-"), F.timestamp_seconds(F.lit(NOW))
    known = spark.createDataFrame([("n/a.bin",), ("n/a.bin",), ("n/gone.bin",)], "key string")
    assert keys(folders.to_archive(files, known, "60 seconds", now)) == ["n/later.bin", "n/sub/c.bin", "n/sub/deep/f g%.bin"]
    assert keys(folders.to_archive(files, known, now=now)) == ["n/b.bin", "n/later.bin", "n/sub/c.bin", "n/sub/deep/f g%.bin"]
    assert keys(folders.still_known(known.distinct(), files)) == ["n/a.bin"]
    assert keys(folders.to_archive(files, files.select("key"))) == []


def test_changed_folders(spark, tree):
    files = folders.listing(spark, tree, "n", "skip-")
    first = folders.changed_folders(files, spark.createDataFrame([], "folder string, modified timestamp"))
    rows = [(r.folder, r.modified) for r in first.collect()]
    assert sorted(f for f, _ in rows) == ["n", "n/sub", "n/sub/deep"]
    seen = spark.createDataFrame(rows, "folder string, modified timestamp")
    assert folders.changed_folders(files, seen).count() == 0
    os.utime(f"{tree}/sub/c.bin", (NOW - 5, NOW - 5))
    assert [r.folder for r in folders.changed_folders(folders.listing(spark, tree, "n", "skip-"), seen).collect()] == ["n/sub"]


def test_empty_folder(spark, tmp_path):
    files = folders.listing(spark, str(tmp_path), "n")
    assert keys(folders.to_archive(files, spark.createDataFrame([], "key string"))) == []


def test_contents_are_not_read(spark, tree):
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in folders.listing(spark, tree, "n")._jdf.queryExecution().executedPlan().toString()
