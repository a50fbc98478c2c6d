"""A publish is all or nothing whichever call of the file system fails, and nothing stored is lost."""

import shutil

import pytest
from pyspark.sql import functions as F

from ledgerflow.sources import files


class Flaky:
    """A file system whose calls fail from the n-th on, for ``length`` calls; renames give false instead."""

    def __init__(self, fs, plan):
        self.fs, self.plan = fs, plan

    def __getattr__(self, name):
        def call(*args):
            self.plan["calls"] += 1
            if self.plan["from"] <= self.plan["calls"] < self.plan["from"] + self.plan["length"]:
                self.plan["failed"].append(name)
                if name == "rename" and self.plan["quiet"]:
                    return False
                raise OSError(f"{name} failed")
            return getattr(self.fs, name)(*args)

        return call


def rows(df):
    return sorted((str(r.date), r.v) for r in df.select("date", "v").collect())


OLD = [("2020-01-01", 1), ("2020-01-02", 2), ("2020-01-03", 3)]
NEW = [("2020-01-01", 10), ("2020-01-03", 30), ("2020-01-04", 40)]  # 01-02 is declared and has no rows any more


def frame(spark, data):
    return spark.createDataFrame(data, "date string, v long").coalesce(1)


@pytest.mark.parametrize("quiet, length", [(True, 1), (False, 10_000)])
def test_any_failing_call_leaves_the_old_or_the_new_rows(spark, tmp_dir, monkeypatch, quiet, length):
    real, seen, k = files._files, set(), 0
    files.replace_partitions(frame(spark, OLD), f"{tmp_dir}/old", "date", [d for d, _ in OLD])
    while True:
        k += 1
        root = f"{tmp_dir}/{k}"
        shutil.copytree(f"{tmp_dir}/old", root)
        plan = {"calls": 0, "from": k, "length": length, "failed": [], "quiet": quiet}

        def flaky(session, path, plan=plan):
            fs, path_class = real(session, path)
            return Flaky(fs, plan), path_class

        with monkeypatch.context() as m:
            m.setattr(files, "_files", flaky)
            try:
                files.replace_partitions(frame(spark, NEW), root, "date", [d for d, _ in NEW] + ["2020-01-02"])
            except OSError:
                pass
        if not plan["failed"]:
            break
        state = rows(files.read_lake(spark, root))
        assert state in (OLD, NEW)
        seen.add(state == NEW)
        files.settle(spark, root)
        assert rows(spark.read.parquet(root)) == state
        if k % 6:
            continue
        # the next run goes through, whatever was left behind
        files.replace_partitions(frame(spark, NEW), root, "date", [d for d, _ in NEW] + ["2020-01-02"])
        assert rows(files.read_lake(spark, root)) == NEW == rows(spark.read.parquet(root))
    assert k > 15 and seen == {True, False}


def test_undeclared_rows_change_nothing(spark, tmp_dir):
    files.replace_partitions(frame(spark, OLD), f"{tmp_dir}/t", "date", [d for d, _ in OLD])
    with pytest.raises(ValueError):
        files.replace_partitions(frame(spark, NEW), f"{tmp_dir}/t", "date", ["2020-01-01"])
    assert rows(files.read_lake(spark, f"{tmp_dir}/t")) == OLD


def test_two_writers_can_t_both_publish(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/t"
    files.replace_partitions(frame(spark, OLD), root, "date", [d for d, _ in OLD])
    before, first = files._manifest, []

    def late(session, path):
        found = before(session, path)
        if len(first) == 1:  # the other one publishes after this one has taken its number
            first.append(1)
            with monkeypatch.context() as m:
                m.setattr(files, "_manifest", before)
                files.replace_partitions(frame(spark, [("2020-01-01", 7)]), path, "date", ["2020-01-01"])
        first.append(0) if not first else None
        return found

    with monkeypatch.context() as m:
        m.setattr(files, "_manifest", late)
        with pytest.raises(OSError):
            files.replace_partitions(frame(spark, NEW), root, "date", [d for d, _ in NEW])
    assert rows(files.read_lake(spark, root)) == [("2020-01-01", 7), *OLD[1:]]


def test_published_rows_are_read_before_they_are_moved(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/t"
    files.replace_partitions(frame(spark, OLD), root, "date", [d for d, _ in OLD])
    calls = []

    def once(session, path):
        calls.append(path)
        if len(calls) > 1:
            raise OSError("stopped")
        return None

    with monkeypatch.context() as m:
        m.setattr(files, "settle", once)
        with pytest.raises(OSError):
            files.replace_partitions(frame(spark, NEW).withColumn("w", F.lit(1)), root, "date", [d for d, _ in NEW])
    assert rows(files.read_lake(spark, root)) == [NEW[0], OLD[1], *NEW[1:]]
    assert rows(spark.read.parquet(root)) == OLD  # what was there is untouched until it is moved
