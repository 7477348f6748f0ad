"""CSV loading, whole-table refresh and publishing."""

import shutil
from datetime import date
from decimal import Decimal

import pytest
from micro import event, raw_table, rows

from cartwright.catalog import QUERIES
from cartwright.fixed_values import NULL_TOKENS, RAW_COLUMNS
from cartwright.plans import marts
from cartwright.plans.star import read_star, run_build
from cartwright.sources import csv_events, store

HEADER = ",".join(RAW_COLUMNS)
ROW = "2020-09-24 11:57:06 UTC,view,1996170,2144415922528452715,electronics.telephone,acme,31.905,15,LJug"


def csv(tmp_path, *lines, name="events.csv"):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_reads_by_name_types_and_drops_extra_columns(spark, tmp_path):
    path = csv(
        tmp_path,
        "price,extra,user_session,user_id,brand,category_code,category_id,product_id,event_type,event_time",
        '31.905,x,abc,15,"big ""red"", co",NA,2144415922528452715,7,view,2020-09-24 11:57:06 UTC',
        "1e1,,,16,,a.b,3,8,cart,2020-09-24 11:57:06.25 UTC",
    )
    loaded = csv_events.read_event_csv(spark, path)
    assert loaded.columns == list(RAW_COLUMNS)
    assert loaded.orderBy("user_id").selectExpr("unix_micros(event_time)").collect()[1][0] == (
        1600948626250000
    )
    assert rows(loaded.drop("event_time")) == [
        ("cart", 8, 3, "a.b", None, Decimal("10.0000"), 16, None),
        ("view", 7, 2144415922528452715, None, 'big "red", co', Decimal("31.9050"), 15, "abc"),
    ]


def test_missing_columns_are_named(spark, tmp_path):
    path = csv(tmp_path, HEADER.replace("price,", "").replace("brand,", ""))
    with pytest.raises(ValueError, match="brand, price"):
        csv_events.read_event_csv(spark, path)


@pytest.mark.parametrize("token", NULL_TOKENS)
def test_null_tokens(spark, tmp_path, token):
    path = csv(tmp_path, HEADER, ROW.replace("acme", token))
    assert rows(csv_events.read_event_csv(spark, path), "brand") == [(None,)]


@pytest.mark.parametrize(
    "old, new",
    [("31.905", "cheap"), ("31.905", "NA"), ("31.905", "1.23456"), ("view", ""),
     ("1996170", "1.5"), ("2020-09-24 11:57:06 UTC", "yesterday"), ("LJug", "LJug,surplus")],
)
def test_bad_rows_fail_the_load(spark, tmp_path, old, new):
    path = csv(tmp_path, HEADER, ROW, ROW.replace(old, new))
    with pytest.raises(Exception, match="bad value|too many fields"):
        csv_events.load_events(spark, path, str(tmp_path / "root"))
    with pytest.raises(store.NothingStored):
        csv_events.raw_events(spark, str(tmp_path / "root"))


def test_short_row_is_padded(spark, tmp_path):
    path = csv(tmp_path, HEADER, ROW.replace(",LJug", ""))
    assert rows(csv_events.read_event_csv(spark, path), "user_session") == [(None,)]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = csv(tmp_path, HEADER, ROW.replace("acme", '"two\nlines"'))
    loaded = csv_events.read_event_csv(spark, path, multi_line=True)
    assert rows(loaded, "brand") == [("two\nlines",)]


def test_load_replaces_and_build_and_publish_follow(spark, tmp_path):
    root = str(tmp_path / "root")
    path = csv(tmp_path, HEADER, ROW, ROW)
    assert csv_events.load_events(spark, path, root) == 2
    later = ROW.replace("view", "purchase")
    path = csv(tmp_path, HEADER, ROW, later, later.replace(",15,", ",16,"), name="b.csv")
    assert csv_events.load_events(spark, path, root) == 3

    assert rows(run_build(spark, root)) == rows(run_build(spark, root)) == [
        ("dim_products", 1), ("dim_users", 2), ("fct_events", 3), ("fct_sessions", 1),
    ]
    star = read_star(spark, root)
    assert rows(star.users, "user_id", "cohort_week") == [
        (15, date(2020, 9, 21)), (16, date(2020, 9, 21)),
    ]

    marts.publish_all(spark, star, root)
    for name, plan in marts.PUBLISHED.items():
        live = plan(star)
        published = marts.read_published(spark, name, root)
        assert published.columns == live.columns
        assert published.dtypes == marts.typed(name, live).dtypes, name
        assert published.collect() == marts.typed(name, live).collect(), name


def test_published_result_stands_in_for_a_missing_star(spark, tmp_path):
    root = str(tmp_path / "root")
    with pytest.raises(store.NothingStored):
        marts.compute_or_published(spark, "overview", root)
    run = store.new_run(f"{root}/marts")
    marts.publish("overview", spark.sql("select 5 total_users, 1 buyers, 2.50 total_revenue, 9 e, 1 s, 2 p"), run)
    store.commit(spark, run)
    published = marts.compute_or_published(spark, "overview", root)
    assert rows(published) == [(5, 1, Decimal("2.50"), 9, 1, 2)]

    csv_events.store_raw(spark, raw_table(spark, event("2020-10-05 10:00:00")), root)
    run_build(spark, root)
    live = marts.compute_or_published(spark, "overview", root)
    assert live.first().total_users == 1 and live.dtypes == published.dtypes


def test_build_needs_events(spark, tmp_path):
    root = str(tmp_path / "root")
    csv_events.store_raw(spark, raw_table(spark), root)
    with pytest.raises(ValueError, match="empty"):
        run_build(spark, root)


def test_uncommitted_run_is_invisible(spark, tmp_path):
    root = str(tmp_path / "root")
    csv_events.store_raw(spark, raw_table(spark, event("2020-10-05 10:00:00")), root)
    unfinished = store.new_run(f"{root}/raw")
    store.write_table(raw_table(spark), f"{unfinished}/raw_events")
    assert csv_events.raw_events(spark, root).count() == 1


def test_a_load_counts_without_reading_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    many = raw_table(spark, *[event("2020-10-05 10:00:00", user=i) for i in range(300)]).repartition(7)
    with monkeypatch.context() as patch:
        patch.setattr(csv_events, "raw_events", None)
        assert csv_events.store_raw(spark, many, root) == 300
        assert csv_events.store_raw(spark, many.where("user_id < 0"), root) == 0
        assert csv_events.store_raw(spark, many.join(many.select("user_id").distinct(), "user_id"), root) == 300
    assert csv_events.raw_events(spark, root).count() == 300


def test_overlapping_refreshes_count_by_commit(spark, tmp_path):
    root = str(tmp_path / "root")
    first, second = store.new_run(root), store.new_run(root)
    for run in (first, second):
        spark.range(1).write.parquet(f"{run}/t")
    store.commit(spark, second)
    assert store.latest_run(spark, root) == second
    store.commit(spark, first)
    assert store.latest_run(spark, root) == first
    assert store.is_committed(spark, first) and not store.is_committed(spark, store.new_run(root))


def test_pruning_keeps_the_last_runs_and_those_under_way(spark, tmp_path):
    root = str(tmp_path / "root")
    runs = [store.new_run(root) for _ in range(5)]
    for run in runs:
        spark.range(3).write.parquet(f"{run}/t")
    for run in runs[:3]:
        store.commit(spark, run)
    held = spark.read.parquet(f"{runs[1]}/t")
    store.prune(spark, root)
    assert held.count() == 3 and store.latest_run(spark, root) == runs[2]
    left = {p.name for p in (tmp_path / "root").glob("run-*")}
    assert left == {run.rpartition("/")[2] for run in runs[1:]}
    store.prune(spark, root, keep=1, abandoned_hours=0)
    assert {p.name for p in (tmp_path / "root").glob("run-*")} == {runs[2].rpartition("/")[2]}
    store.commit(spark, runs[2])
    assert store.latest_run(spark, root) == runs[2]


def test_changed_inputs_are_built_again(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    folder = str(tmp_path)
    for name in ("orders", "part"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", folder)
    lines.write.parquet(f"{folder}/lineitem.parquet")
    query = QUERIES["raw_events_row_count"]
    before = query(spark, folder).first().row_count
    assert query(spark, folder).first().row_count == before
    lines.limit(100).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    assert query(spark, folder).first().row_count > before


def test_any_event_type_is_stored_as_it_is(spark, tmp_path):
    kinds = ["view", "purchase", "Purchase", "1", "01", "a=b/c", " x", "null", "%41", "", "other"]
    events = [event("2020-10-05 10:00:00", kind=k, user=i) for i, k in enumerate(kinds)]
    root = str(tmp_path / "root")
    csv_events.store_raw(spark, raw_table(spark, *events), root)
    run_build(spark, root)
    star = read_star(spark, root)
    assert rows(star.events, "user_id", "event_type") == list(enumerate(kinds))
    assert rows(star.purchases, "user_id", "event_type") == [(1, "purchase")]
    assert star.purchases.columns == star.events.columns == list(RAW_COLUMNS)
