"""What a task holds stays bounded, however large the stored tables are."""

import glob

import pytest

from cartwright import session
from cartwright.plans import star as star_plans
from cartwright.session import prepare, work_dir
from cartwright.sources import csv_events, store
from cartwright.sources.order_lines import events_from_order_lines

SF_DIR = "/root/testdata/sf0.001"
PARTITIONS = "spark.sql.shuffle.partitions"
SCAN, ADVISORY = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def fresh(spark):
    """A session with settings of its own."""
    own = spark.newSession()
    own.conf.set(PARTITIONS, "2")
    return own


def test_large_tasks_are_cut(fresh):
    fresh.conf.set(SCAN, "1g")
    fresh.conf.set(ADVISORY, "256MB")
    prepare(fresh)
    assert fresh.conf.get(SCAN) == f"{session.SCAN_BYTES}b"
    assert fresh.conf.get(ADVISORY) == f"{session.SHUFFLE_BYTES}b"


@pytest.mark.parametrize("size", ["64k", "65536", "65536b", "64KB"])
def test_small_tasks_stay(fresh, size):
    fresh.conf.set(SCAN, size)
    fresh.conf.set(ADVISORY, size)
    prepare(fresh)
    assert fresh.conf.get(SCAN) == fresh.conf.get(ADVISORY) == size


def test_partitions_follow_the_stored_bytes(fresh):
    session.deal(fresh, 10 * session.DEAL_BYTES + 1)
    assert fresh.conf.get(PARTITIONS) == "11"
    session.deal(fresh, session.DEAL_BYTES)
    assert fresh.conf.get(PARTITIONS) == "11"
    session.deal(fresh, session.DEAL_BYTES << 20)
    assert fresh.conf.get(PARTITIONS) == str(session.MOST_PARTITIONS)


def test_build_in_many_small_tasks(fresh, monkeypatch):
    """The build shuffles into as many partitions as its raw table asks for; the rows are the same."""
    prepare(fresh)
    root = store.new_run(f"{work_dir(fresh)}/tasks")
    csv_events.store_raw(fresh, events_from_order_lines(fresh, SF_DIR), root)
    stored = csv_events.raw_bytes(fresh, root)
    few = star_plans.run_build(fresh, root).collect()
    assert fresh.conf.get(PARTITIONS) == "2"
    monkeypatch.setattr(session, "DEAL_BYTES", stored // 9)
    many = star_plans.run_build(fresh, root).collect()
    assert int(fresh.conf.get(PARTITIONS)) == -(-stored // (stored // 9)) >= 9
    assert sorted(few) == sorted(many)
    assert glob.glob(f"{root.removeprefix('file:')}/**/*.zstd.parquet", recursive=True)
