"""Versions of a table: failures between any two steps keep the old one."""

import pytest
from pyspark.sql import functions as F

from tagloom.sources.snapshots import Conflict, Snapshot

SCHEMA = "day string, hour int, n long"


@pytest.fixture()
def table(spark, tmp_path):
    return Snapshot(spark, f"{tmp_path}/table")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def got(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


def test_replace_upsert_and_range(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    a = [("mon", 1, 1), ("mon", 2, 2), ("tue", 1, 3), (None, None, 4), ("a/b=c%", 1, 5)]
    assert table.replace(frame(spark, *a), "day", "hour") == 1 and got(table.read()) == sorted(a, key=repr)
    assert table.upsert(frame(spark, ("mon", 2, 20), (None, None, 40), ("wed", 1, 6)), "day", "hour") == 2
    b = [("mon", 1, 1), ("mon", 2, 20), ("tue", 1, 3), (None, None, 40), ("a/b=c%", 1, 5), ("wed", 1, 6)]
    assert got(table.read()) == sorted(b, key=repr) and got(table.read(1)) == sorted(a, key=repr)
    assert got(table.read(day="mon")) == [("mon", 1, 1), ("mon", 2, 20)] and got(table.read(day=["mon", "a/b=c%"], hour=1)) == [("a/b=c%", 1, 5), ("mon", 1, 1)]
    assert table.replace_range(frame(spark, ("thu", 9, 9)), F.col("n") >= 5) == 3
    assert got(table.read()) == sorted([("mon", 1, 1), ("tue", 1, 3), ("thu", 9, 9)], key=repr)
    assert table.replace(frame(spark), "day", "hour") == 4 and got(table.read()) == []
    with pytest.raises(ValueError):
        table.upsert(frame(spark), "day")
    with pytest.raises(ValueError):
        table.read(2, n=1)
    table.expire(keep=2)
    assert sorted(table.versions()) == [3, 4] and got(table.read(3)) == sorted([("mon", 1, 1), ("tue", 1, 3), ("thu", 9, 9)], key=repr)


@pytest.mark.parametrize("step", ["_write", "_mark", "_commit"])
@pytest.mark.parametrize("change", ["replace", "upsert", "replace_range"])
def test_failures_keep_the_old_version(spark, table, monkeypatch, step, change):
    table.replace(frame(spark, ("mon", 1, 1), ("tue", 1, 2)), "day")
    before = got(table.read())

    def lost(self, *a, real=getattr(Snapshot, step), **k):
        if step == "_write":
            real(self, *a, **k)  # the rows are there, nothing else
        raise OSError("lost")

    run = {"replace": lambda: table.replace(frame(spark, ("x", 0, 0)), "day"), "upsert": lambda: table.upsert(frame(spark, ("mon", 0, 0)), "day"), "replace_range": lambda: table.replace_range(frame(spark, ("x", 0, 0)), F.col("n") == 1)}[change]
    with monkeypatch.context() as m:
        m.setattr(Snapshot, step, lost)
        with pytest.raises(OSError, match="lost"):
            run()
    assert got(table.read()) == before and table.version() == 1
    assert run() == 2 and got(table.read()) != before
    assert table.expire(1) >= 1


def test_of_two_writers_one_commits(spark, table):
    table.replace(frame(spark, ("mon", 1, 1)))
    _, parts = table._write(frame(spark, ("mon", 1, 2)), ())
    table._mark(2, "0" * 32)  # another writer was first
    with pytest.raises(Conflict):
        table._commit(table._schema(frame(spark)), (), parts, 1)
    assert table.versions()[2] == "0" * 32 and len(table._names("_versions")) == 2


def test_a_reader_keeps_its_version(spark, table):
    table.replace(frame(spark, ("mon", 1, 1)))
    reader = table.read()
    table.replace(frame(spark, ("mon", 1, 2)))
    assert got(reader) == [("mon", 1, 1)] and got(table.read()) == [("mon", 1, 2)]
