"""Ratings in blocks, exact sums, implicit training, progress and ownership of written tables."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from factorloom.functions import exact
from factorloom.operators import blocks, exchange, normal_equations, objective, solvers
from factorloom.plans.lineage import Tables, cut, scratch
from factorloom.plans.trainers import TRAINERS, train_als, train_ncg, train_pncg
from tests.test_engine import SCHEMA, arrays, low_rank, objective_by_force


@pytest.fixture(scope="module")
def sparse(spark):
    rows = low_rank(30, 40, 4, 0.3, 7)
    rows += rows[:50]
    rows += [(2**40, 3, 0.5), (5, 2**41, 0.0)]
    return spark.createDataFrame(rows, SCHEMA).persist()


def dealt(ratings, key, partitions=3, **more):
    return exchange.deal(ratings, key, blocks.counts(ratings, key), partitions, **more)


@pytest.mark.parametrize("implicit", [False, True])
@pytest.mark.parametrize("part", [1 << 18, 7])
@pytest.mark.parametrize("rank", [3, 14])
def test_solving_equals_the_joined_form(spark, sparse, implicit, part, rank):
    """Also where an entity's ratings lie in several blocks, and at a large rank."""
    users, items = arrays(spark, sparse, rank)
    whole = normal_equations.gram(items, rank) if implicit else None
    wanted = {r.id: r.factor for r in normal_equations.half_step(sparse, "user", items, rank, 0.05, implicit=implicit, alpha=2.0).collect()}
    b = dealt(sparse, "user", part=part)
    assert (b.mine is None) == (part > 100)
    got = {r.id: r for r in exchange.run(b, exchange.solving(rank, 0.05, implicit=implicit, alpha=2.0, whole=whole, state="factor"), items, users, keep=("p",)).collect()}
    assert got.keys() == wanted.keys()
    state = {r.id: r for r in users.collect()}
    for i, r in got.items():
        assert r.solved == pytest.approx(wanted[i], rel=1e-7, abs=1e-9) and r.p == state[i].p and r.factor == state[i].factor
    grads = {r.id: r.grad for r in objective.gradient(sparse, "user", users, items, rank, 0.05).collect()}
    graded = {r.id: r for r in exchange.run(b, exchange.grading(rank, 0.05), items, users).collect()}
    assert all(r.grad == pytest.approx(grads[i], rel=1e-7, abs=1e-8) for i, r in graded.items())
    if not implicit:
        assert all(r.grad == pytest.approx(grads[i], rel=1e-6, abs=1e-8) for i, r in got.items())
    b.unpersist()


def test_ratings_stay_where_they_are(spark, sparse):
    """Above the broadcast threshold too, the packed ratings are read from the cache without an exchange."""
    items = cut(arrays(spark, sparse, 2)[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    b = dealt(sparse, "user", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        made = exchange.run(b, exchange.solving(2, 0.05), items)
        made.collect()
        plan = made._jdf.queryExecution().sparkPlan().toString()
        physical = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in physical.split("InMemoryRelation")[0] and "FlatMapCoGroupsInArrow" in plan
    # the first child of the cogroup is the cached scan itself, the second comes by the only exchange of this level
    below = physical[physical.index("FlatMapCoGroupsInArrow") :].splitlines()
    first = next(line for line in below[1:] if line.strip(" :+-"))
    assert "InMemoryTableScan" in first or "TableCacheQueryStage" in first or "Sort [block" in first
    assert "Exchange hashpartitioning(block" not in "\n".join(below[: next(i for i, line in enumerate(below) if "InMemoryRelation" in line)])
    b.unpersist()


def test_blocks_are_even(spark):
    """Each block has a partition of its own."""
    rows = spark.range(4000).select(F.col("id").alias("user"), (F.col("id") % 7).alias("item"), F.lit(1.0).alias("rating"))
    b = dealt(rows, "user", 8)
    per = [r[0] for r in b.ratings.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert per == [1] * 8
    b.unpersist()


def test_missing_states_are_errors(spark, sparse):
    users, items = arrays(spark, sparse, 2)
    b = dealt(sparse, "user")
    with pytest.raises(Exception, match="no factor"):
        exchange.run(b, exchange.solving(2, 0.05), items.filter("id <> 3")).collect()
    with pytest.raises(Exception, match="no state"):
        exchange.run(b, exchange.grading(2, 0.05), items, users.limit(0)).collect()
    b.unpersist()


def test_exact_sums(spark):
    pick = random.Random(1)
    rows = [(pick.uniform(-1, 1) * 10.0 ** pick.randint(-200, 200), pick.random(), 5e-324 * pick.randint(-3, 3)) for _ in range(3000)] + [(1e308, -0.0, None), (-1e308, 1e-17, 0.0)]
    for n in (1, 5):
        df = spark.createDataFrame(rows, "a double, b double, c double").repartition(n)
        assert exact.exact_sums(df, F.col("a"), F.col("b"), F.col("c")) == [math.fsum(r[j] or 0.0 for r in rows) for j in range(3)]
    assert exact.exact_sums(df.limit(0), F.col("a")) == [0.0]
    assert math.isnan(exact.exact_sums(df.select(F.lit(float("inf")).alias("a")), F.col("a"))[0])


@pytest.mark.parametrize("name", ["als", "ncg", "pncg"])
def test_partitions_dont_change_a_bit(sparse, name):
    runs = [TRAINERS[name](sparse.repartition(n), rank=3, iterations=2, ridge=0.01, seed=1, user_blocks=n, item_blocks=n) for n in (2, 7)]
    one, other = ([tuple(r) for r in m.history.orderBy("iter").collect()] for m in runs)
    assert one == other
    assert len({tuple(sorted((r.id, tuple(r.features)) for r in m.item_factors.collect())) for m in runs}) == 1


def implicit_by_force(rows, users, items, ridge, alpha):
    n, seen = {}, {}
    for u, i, r in rows:
        if r > 0:
            seen.setdefault((u, i), []).append(r)
            n["u", u], n["i", i] = n.get(("u", u), 0) + 1, n.get(("i", i), 0) + 1
    total = ridge * (sum(n.get(("u", u), 0) * x @ x for u, x in users.items()) + sum(n.get(("i", i), 0) * y @ y for i, y in items.items()))
    for u, x in users.items():
        for i, y in items.items():
            z = x @ y
            total += z * z + sum((1 + alpha * r) * (z - 1) ** 2 - z * z for r in seen.get((u, i), ()))
    return total


def test_implicit_objective_and_ray(spark, sparse):
    k, ridge, alpha = 3, 0.07, 1.5
    users, items = arrays(spark, sparse, k)
    liked = {key: {r.id: r.n for r in sparse.groupBy(F.col(key).alias("id")).agg(F.count_if(F.col("rating") > 0).alias("n")).collect()} for key in ("user", "item")}
    states = [spark.createDataFrame([(r.id, float(liked[key][r.id]), r.factor, r.p) for r in side.collect()], "id long, n double, factor array<double>, p array<double>") for key, side in (("user", users), ("item", items))]
    rows = [tuple(r) for r in sparse.collect()]
    known = [{r.id: (np.array(r.factor), np.array(r.p)) for r in s.collect()} for s in states]
    value = lambda t: implicit_by_force(rows, *({i: x + t * p for i, (x, p) in side.items()} for side in known), ridge, alpha)
    assert objective.implicit_cost(sparse, *states, k, ridge, alpha) == pytest.approx(value(0), rel=1e-10)
    c = objective.implicit_ray(sparse, *states, k, ridge, alpha)
    assert all(solvers.horner(c, t) == pytest.approx(value(t), rel=1e-9) for t in (-1.1, 0.3, 2.0))


@pytest.mark.parametrize("name", ["als", "ncg", "pncg"])
def test_implicit_training_descends(sparse, name):
    model = TRAINERS[name](sparse, rank=3, iterations=4, ridge=0.05, implicit=True, alpha=2.0, seed=2)
    history = model.history.orderBy("iter").collect()
    assert len(history) == 5 and all(b.loss <= a.loss * (1 + 1e-9) for a, b in zip(history, history[1:], strict=False)) and history[-1].loss < history[0].loss
    # what is told is the objective at the factors, up to their rounding to floats
    known = [{r.id: np.array(r.features) for r in df.collect()} for df in (model.user_factors, model.item_factors)]
    assert history[-1].loss == pytest.approx(implicit_by_force([tuple(r) for r in sparse.collect()], *known, 0.05, 2.0), rel=1e-4)
    if name != "als":
        assert history[-1].grad_norm < history[0].grad_norm * 10 and history[1].alpha > 0


@pytest.mark.parametrize("implicit", [False, True])
def test_nonnegative_conjugate_gradients(spark, implicit):
    """No factor below 0, a loss that never rises, and the minimum that more alternating steps go to."""
    pick = random.Random(3)
    u, v = ([[max(0.0, pick.gauss(0.3, 1)) for _ in range(2)] for _ in range(n)] for n in (20, 25))
    rows = [(i, j, sum(a * b for a, b in zip(u[i], v[j], strict=True)) + pick.gauss(-0.2, 0.3)) for i in range(20) for j in range(25) if pick.random() < 0.6]
    ratings = spark.createDataFrame(rows, SCHEMA)
    same = {"rank": 2, "ridge": 0.01, "nonnegative": True, "seed": 4, "implicit": implicit, "alpha": 2.0}
    model = train_pncg(ratings, iterations=12, **same)
    losses = [r.loss for r in model.history.orderBy("iter").collect()]
    assert all(b <= a * (1 + 1e-12) for a, b in zip(losses, losses[1:], strict=False))
    factors = [np.array(r.features) for df in (model.user_factors, model.item_factors) for r in df.collect()]
    assert min(f.min() for f in factors) >= 0 and any((f == 0).any() for f in factors)
    alternating = train_als(ratings, iterations=18, **same).history.orderBy(F.desc("iter")).first().loss
    assert losses[-1] <= alternating * 1.005


def test_explicit_history_is_the_objective(sparse):
    rows = [tuple(r) for r in sparse.collect()]
    for train in (train_als, train_ncg, train_pncg):
        model = train(sparse, rank=3, iterations=2, ridge=0.05, seed=2, part=5)
        known = [{r.id: np.array(r.features) for r in df.collect()} for df in (model.user_factors, model.item_factors)]
        assert model.history.orderBy(F.desc("iter")).first().loss == pytest.approx(objective_by_force(rows, *known, 0.05), rel=1e-4)


@pytest.mark.parametrize("name", ["als", "ncg", "pncg"])
def test_a_broken_off_training_goes_on(sparse, tmp_path, name):
    same = {"rank": 2, "ridge": 0.02, "seed": 5}
    facts = lambda m: ([tuple(r) for r in m.history.orderBy("iter").collect()], sorted((r.id, tuple(r.features)) for r in m.user_factors.collect()))
    whole = facts(TRAINERS[name](sparse, iterations=5, **same))
    folder = str(tmp_path / "progress")
    TRAINERS[name](sparse, iterations=3, progress=folder, **same)
    os.makedirs(f"{folder}/00000004/user")  # broken off while it wrote: it has no manifest
    assert facts(TRAINERS[name](sparse, iterations=5, progress=folder, interval=2, **same)) == whole
    assert sorted(os.listdir(folder)) == ["00000003", "00000004"]  # the two latest; what was broken off is written anew
    with pytest.raises(ValueError, match="rank"):
        TRAINERS[name](sparse, iterations=5, progress=folder, **{**same, "rank": 3})


def written(spark):
    folder = os.path.dirname(scratch(spark)).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_written_tables_are_deleted(spark, sparse):
    before = written(spark)
    with train_pncg(sparse, rank=2, iterations=2) as model:
        assert len(written(spark) - before) == 2  # the factors' own
        assert model.errors(sparse).first().n == sparse.count()
    assert written(spark) == before
    kept = train_als(sparse, rank=2, iterations=1, final_level=StorageLevel.NONE)
    kept.tables.share()
    kept.close()
    assert kept.user_factors.count() > 0  # another reader is left
    kept.close()
    assert written(spark) == before
    with pytest.raises(ZeroDivisionError), Tables():
        cut(spark.range(3).toDF("x"))
        raise ZeroDivisionError
    assert written(spark) == before


def test_the_folder_goes_with_the_session(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate()
from factorloom.plans.lineage import cut
import glob
cut(spark.range(5).toDF("x"))
print("tables", len(glob.glob("{tmp_path}/shared/**/factorloom-*/*", recursive=True)))
"""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": here})
    assert "tables 1" in run.stdout, run.stderr[-500:]
    left = [f for d, _, names in os.walk(tmp_path) for f in names if "factorloom" in d]
    assert left == []


def test_near_ids_share_a_block(spark):
    """Four groups of users who rate their own items only: a factor goes to one block or two, not to all."""
    rows = [(100 * g + u, 1000 * g + i, 1.0) for g in range(4) for u in range(50) for i in range(40)]
    ratings = spark.createDataFrame(rows, "user long, item long, rating double").persist()
    b = dealt(ratings, "user", 4)
    assert b.theirs.count() <= 2 * 4 * 40
    sizes = b.ratings.select(F.expr("octet_length(rating) / 8").alias("n")).collect()
    assert len(sizes) == 4 and max(r.n for r in sizes) <= 1.5 * len(rows) / 4
    b.unpersist()
    huge = spark.createDataFrame([(2**62 + j, j, 1.0) for j in range(64)], "user long, item long, rating double")
    b = dealt(huge, "user", 4)  # ids that no double tells apart
    assert b.ratings.select(F.sum(F.expr("octet_length(rating) / 8"))).first()[0] == 64
    b.unpersist()


def test_the_exchange_that_dealt_ratings_isnt_kept(spark, sparse):
    """Cached blocks come from a written table, so the shuffle files of the ratings can go; the table goes with the blocks."""
    before = written(spark)
    b = dealt(sparse, "user")
    plan = b.ratings._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "parquet" in plan
    assert len(written(spark) - before) == 1
    b.unpersist()
    assert written(spark) == before
