"""Keys and references that don't hold, each counted by its own rule."""

import random

from cartwright.operators import constraints


def table(spark, values, name="k"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def found(parent, *children):
    rows = constraints.key_checks(parent, "k", [(c, c.columns[0]) for c in children]).collect()
    return [r["violations"] for r in sorted(rows, key=lambda r: int(r["check"]))]


def test_repeated_keys_and_orphans(spark):
    parent = table(spark, [1, 2, 2, 3, 3, 3, None])
    assert found(parent, table(spark, [1, 1, 9, 9, 8, None], "a"), table(spark, [2, None, None], "b")) == [2, 3, 0]
    assert found(table(spark, [None, None])) == [1]
    assert found(table(spark, []), table(spark, [5, 5, None], "a")) == [0, 2]
    assert found(table(spark, []), table(spark, [], "a")) == [0, 0]


def test_random_tables(spark):
    rng = random.Random(1)
    for _ in range(4):
        parent = [rng.choice([None, *range(30)]) for _ in range(40)]
        children = [[rng.choice([None, *range(45)]) for _ in range(60)] for _ in range(2)]
        want = [sum(parent.count(v) > 1 for v in set(parent))]
        want += [sum(v is not None and v not in parent for v in c) for c in children]
        assert found(table(spark, parent), *[table(spark, c, f"c{i}") for i, c in enumerate(children)]) == want


def test_one_shuffle_for_a_key_and_all_its_references(spark, tmp_path):
    frames = []
    for name in ("k", "a", "b"):
        table(spark, range(100), name).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    checks = constraints.key_checks(frames[0], "k", [(frames[1], "a"), (frames[2], "b")])
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert plan.index("Exchange hashpartitioning") < plan.rindex("partial_sum")  # summed before it
