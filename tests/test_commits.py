"""Commits of overlapping refreshes, on stores that never refuse a write."""

import os
import time

import pytest
from cartwright.sources import store
from cartwright.sources.files import Files


class Overlapping(Files):
    """Another writer commits between this one's look at the marks and its own mark; the store lets both through."""

    def __init__(self, spark, other):
        super().__init__(spark)
        self.other = other

    def write(self, path, text):
        other, self.other = self.other, None
        if other:
            other()
        super().write(path, text)


class Forgetful(Files):
    def write(self, path, text):
        pass


def runs_of(spark, root, n):
    made = sorted(store.new_run(root) for _ in range(n))
    for run in made:
        spark.range(1).write.parquet(f"{run}/t")
    return made


@pytest.mark.parametrize("first", [True, False])
def test_two_writers_at_once(spark, tmp_path, first):
    """Both commits hold, all readers see the same one, and the one that yields is told so."""
    root = str(tmp_path / "root")
    low, high = runs_of(spark, root, 2)
    mine, others = (low, high) if first else (high, low)
    told = []
    newest = store.commit(spark, mine, Overlapping(spark, lambda: told.append(store.commit(spark, others))))
    assert told == [True] and newest == (not first)
    assert store.latest_run(spark, root) == high
    assert store.is_committed(spark, low) and store.is_committed(spark, high)
    later, = runs_of(spark, root, 1)
    assert store.commit(spark, later) and store.latest_run(spark, root) == later


def test_many_writers_in_a_row(spark, tmp_path):
    root = str(tmp_path / "root")
    for run in runs_of(spark, root, 12)[::-1]:
        assert store.commit(spark, run) and store.latest_run(spark, root) == run


def test_a_mark_that_does_not_show_is_an_error(spark, tmp_path):
    run, = runs_of(spark, str(tmp_path / "root"), 1)
    with pytest.raises(store.CommitLost):
        store.commit(spark, run, Forgetful(spark))
    assert not store.is_committed(spark, run)


def test_a_long_build_is_not_taken_for_abandoned(spark, tmp_path):
    """The folder is old, what is written deep below it is not."""
    root = tmp_path / "root"
    busy, idle, done = runs_of(spark, str(root), 3)
    store.commit(spark, done)
    long_ago = time.time() - 48 * 3600
    for run in (busy, idle):
        for folder, _, names in os.walk(run):
            for name in names:
                os.utime(os.path.join(folder, name), (long_ago, long_ago))
            os.utime(folder, (long_ago, long_ago))
    deep = os.path.join(busy, "t", "_temporary", "0")
    os.makedirs(deep)
    with open(os.path.join(deep, "part-0"), "w") as file:
        file.write("x")
    os.utime(os.path.join(busy, "t"), (long_ago, long_ago))
    os.utime(busy, (long_ago, long_ago))
    store.prune(spark, str(root))
    assert os.path.exists(busy) and not os.path.exists(idle) and os.path.exists(done)
