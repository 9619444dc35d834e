import math
import random

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from factorloom import cli
from factorloom.functions import vectors
from factorloom.operators import blocks, normal_equations, objective, solvers
from factorloom.plans.model import FactorModel, weighted_rmse
from factorloom.plans.trainers import train_als, train_ncg, train_pncg
from factorloom.sources import ratings as sources
from factorloom.streaming.scoring import score

SCHEMA = "user long, item long, rating double"


class PublicRandom:
    """The published linear congruential generator of 48 bits."""

    def __init__(self, seed):
        self.s = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def next(self, bits):
        self.s = (self.s * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.s >> (48 - bits)

    def double(self):
        return ((self.next(26) << 27) + self.next(27)) / float(1 << 53)


def low_rank(users, items, rank, share=1.0, seed=42):
    draw = PublicRandom(seed)
    u = np.array([2 * draw.double() - 1 for _ in range(users * rank)]).reshape(rank, users).T
    v = np.array([2 * draw.double() - 1 for _ in range(items * rank)]).reshape(items, rank).T
    full = u @ v
    return [(i, j, float(full[i, j])) for i in range(users) for j in range(items) if draw.double() < share]


@pytest.fixture(scope="module")
def dense(spark):
    return spark.createDataFrame(low_rank(100, 300, 15), SCHEMA).persist()


@pytest.fixture(scope="module")
def sparse(spark):
    rows = low_rank(30, 40, 4, 0.3, 7)
    rows += rows[:50]  # repeated ratings are observations of their own
    rows += [(2**40, 3, 0.5), (5, 2**41, 0.0)]
    return spark.createDataFrame(rows, SCHEMA).persist()


def arrays(spark, ratings, k, salt=0):
    users, items = (blocks.counts(ratings, key).select("id", F.col("n").cast("double").alias("n"), vectors.lattice(F.col("id"), k, salt + s).alias("factor"), vectors.lattice(F.col("id"), k, 9 + s).alias("p")) for key, s in (("user", 0), ("item", 5)))
    return users, items


def objective_by_force(rows, users, items, ridge):
    n = {}
    for u, i, _ in rows:
        n["u", u] = n.get(("u", u), 0) + 1
        n["i", i] = n.get(("i", i), 0) + 1
    error = sum((np.dot(users[u], items[i]) - r) ** 2 for u, i, r in rows)
    return error + ridge * sum(n["u", u] * np.dot(x, x) for u, x in users.items()) + ridge * sum(n["i", i] * np.dot(x, x) for i, x in items.items())


def test_als_reaches_the_truth(dense):
    model = train_als(dense, rank=15, iterations=20, ridge=1e-3, seed=1)
    assert model.errors(dense).first().max_error <= 0.1
    losses = [r.loss for r in model.history.orderBy("iter").collect()]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(losses, losses[1:], strict=False))


def test_pncg_reaches_the_truth(dense):
    model = train_pncg(dense, rank=15, iterations=20, ridge=1e-3, seed=1)
    assert model.errors(dense).first().max_error <= 0.1
    losses = [r.loss for r in model.history.orderBy("iter").collect()]
    assert len(losses) == 21 and all(b <= a * (1 + 1e-9) for a, b in zip(losses, losses[1:], strict=False))


def test_ncg_descends(sparse):
    history = train_ncg(sparse, rank=3, iterations=6, ridge=0.01, seed=3).history.orderBy("iter").collect()
    assert history[-1].loss < history[0].loss and all(b.loss <= a.loss * (1 + 1e-9) for a, b in zip(history, history[1:], strict=False))


def test_seeds(sparse):
    factors = lambda seed, n=None: {r.id: r.features for r in train_pncg(sparse.repartition(n or 2), rank=3, iterations=1, ridge=0.01, seed=seed, user_blocks=n).user_factors.collect()}
    one, again, other = factors(1), factors(1, 5), factors(2)
    assert all(one[i] == pytest.approx(again[i], rel=1e-4, abs=1e-6) for i in one)  # blocks and order don't matter
    assert any(one[i] != pytest.approx(other[i], rel=1e-3) for i in one)


def test_storage_levels(sparse):
    model = train_als(sparse, rank=2, iterations=1, final_level=StorageLevel.DISK_ONLY)
    assert model.user_factors.storageLevel == StorageLevel.DISK_ONLY == model.item_factors.storageLevel
    assert train_als(sparse, rank=2, iterations=1, final_level=StorageLevel.NONE).user_factors.storageLevel == StorageLevel.NONE
    with pytest.raises(ValueError):
        train_als(sparse, rank=2, intermediate_level=StorageLevel.NONE)


def test_random_start(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 7, 2**40, -3)], "id long")
    vec = lambda seed, side, n: {r.id: r.v for r in ids.repartition(n).select("id", vectors.random_unit(F.col("id"), 6, seed, side).alias("v")).collect()}
    one = vec(1, 0, 1)
    assert one == vec(1, 0, 4) and one != vec(2, 0, 1) and one != vec(1, 1, 1)
    assert all(min(v) >= 0 and math.isclose(np.dot(v, v), 1) for v in one.values())


def test_gradient_and_ray(spark, sparse):
    k, ridge = 3, 0.07
    users, items = arrays(spark, sparse, k)
    rows = [tuple(r) for r in sparse.collect()]
    state = [{r.id: (np.array(r.factor), np.array(r.p)) for r in side.collect()} for side in (users, items)]
    value = lambda t: objective_by_force(rows, *({i: x + t * p for i, (x, p) in side.items()} for side in state), ridge)
    assert objective.cost(sparse, users, items, k, ridge) == pytest.approx(value(0), rel=1e-10)
    c = objective.ray(sparse, users, items, k, ridge)
    for t in (-1.3, 0.4, 2.0):
        assert solvers.horner(c, t) == pytest.approx(value(t), rel=1e-10)
    assert objective.ray(sparse, users, items, k, ridge, doubled=True)[2] > c[2]
    gradients = [{r.id: np.array(r.grad) for r in objective.gradient(sparse, key, *pair, k, ridge).collect()} for key, pair in (("user", (users, items)), ("item", (items, users)))]
    slope = sum(np.dot(g[i], state[n][i][1]) for n, g in enumerate(gradients) for i in g)
    assert slope == pytest.approx((value(1e-5) - value(-1e-5)) / 2e-5, rel=1e-6)
    both = normal_equations.normal_equations(sparse, "user", items, k).join(users.select("id", "factor"), "id")
    solved = {r.id: r for r in normal_equations.solve(both, k, ridge, state=F.col("factor")).collect()}
    assert all(r.grad == pytest.approx(gradients[0][i], rel=1e-8, abs=1e-9) for i, r in solved.items())


@pytest.mark.parametrize("nonnegative", [False, True])
@pytest.mark.parametrize("implicit", [False, True])
def test_half_step_solves_its_problem(spark, sparse, nonnegative, implicit):
    k, ridge, alpha = 4, 0.05, 2.0
    _, items = arrays(spark, sparse, k)
    y = {r.id: np.array(r.factor) for r in items.collect()}
    got = {r.id: np.array(r.factor) for r in normal_equations.half_step(sparse, "user", items, k, ridge, nonnegative, implicit, alpha).collect()}
    rows = {}
    for r in sparse.collect():
        rows.setdefault(r.user, []).append((y[r.item], r.rating))
    whole = sum(np.outer(v, v) for v in y.values()) if implicit else 0
    for u, seen in rows.items():
        if implicit:
            liked = [(v, r) for v, r in seen if r > 0]
            a = whole + sum((alpha * r * np.outer(v, v) for v, r in liked), np.zeros((k, k))) + ridge * len(liked) * np.eye(k)
            b = sum(((1 + alpha * r) * v for v, r in liked), np.zeros(k))
        else:
            a, b = sum(np.outer(v, v) for v, _ in seen) + ridge * len(seen) * np.eye(k), sum(v * r for v, r in seen)
        pull = a @ got[u] - b
        if nonnegative:  # no component below 0; no force but where a component is held at 0
            assert got[u].min() >= 0 and pull.min() > -1e-8 and np.abs(pull * got[u]).max() < 1e-7
        else:
            assert pull == pytest.approx(np.zeros(k), abs=1e-8)


def test_singular_systems_fail(spark):
    one = spark.createDataFrame([(1, 1, 1.0)], SCHEMA)
    with pytest.raises(Exception, match="positive definite"):
        train_als(one, rank=3, iterations=1, ridge=0.0)


def test_nnls_conditions():
    random = np.random.Generator(np.random.PCG64(0))
    for k in (1, 2, 5, 9):
        a = random.standard_normal((40, k + 3, k))
        gram, right = np.einsum("nij,nik->njk", a, a), random.standard_normal((40, k))
        x = solvers.nnls(gram, right, np.full(40, 0.01))
        pull = np.einsum("nij,nj->ni", gram + 0.01 * np.eye(k), x) - right
        assert (x >= 0).all() and (pull > -1e-9).all() and np.abs(pull * x).max() < 1e-8


def test_minimize():
    assert solvers.minimize([1, -2, 1], [0.0])[0] == pytest.approx(1)
    x, value = solvers.minimize([0, 0, -2, 0, 1], [0.0, 2.0])  # 0 is a maximum
    assert (abs(x), value) == (pytest.approx(1), pytest.approx(-1))
    assert solvers.minimize([3.0, 0, 0, 0, 0], [0.0, 2.0]) == (0.0, 3.0)
    assert solvers.minimize([0, 1, 0.1, -3, 1], [0.0])[1] <= 0


def test_trainer_arguments(sparse):
    with pytest.raises(NotImplementedError):
        train_ncg(sparse, nonnegative=True)
    with pytest.raises(ValueError):
        train_als(sparse, rank=0)
    with pytest.raises(ValueError):
        train_als(sparse, interval=0)


def test_implicit_and_predictions(spark, sparse, tmp_path):
    model = train_als(sparse, rank=3, iterations=3, implicit=True, alpha=3.0, seed=2)
    seen = model.predict(sparse)
    assert 0 <= weighted_rmse(seen).first()[0] < 1
    pairs = spark.createDataFrame([(1, 1), (999, 1), (1, 999)], "user long, item long")
    assert model.predict(pairs).count() == 1
    assert sorted(math.isnan(r.prediction) for r in model.predict(pairs, "nan").collect()) == [False, True, True]
    model.save(str(tmp_path / "model"))
    again = FactorModel.load(spark, str(tmp_path / "model"))
    assert sorted(again.predict(sparse).collect()) == sorted(seen.collect()) and again.rank == 3
    sparse.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = score(spark.readStream.schema(sparse.schema).parquet(str(tmp_path / "in")), model).writeStream.format("memory").queryName("scored").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("scored").count() == seen.count()


def test_hot_user(spark):
    """One user with a third of all ratings."""
    pick = random.Random(4)
    rows = [(0 if i % 3 == 0 else pick.randrange(300), pick.randrange(50), pick.random()) for i in range(6000)]
    ratings = spark.createDataFrame(rows, SCHEMA)
    items = arrays(spark, ratings, 2)[1]
    a = {r.id: r for r in normal_equations.normal_equations(ratings.repartition(9), "user", items, 2).collect()}
    b = {r.id: r for r in normal_equations.normal_sums(ratings, "user", items, 2).collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert [a[i].n, *a[i].g, *a[i].b] == pytest.approx([b[i].n, b[i].g_0, b[i].g_1, b[i].g_2, b[i].b_0, b[i].b_1])


def test_text_source(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1::2::3.5::x\n10 ::20:: -1\n")
    got = sources.read_text(spark, str(tmp_path / "r.txt"), "::")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 3.5), (10, 20, -1.0)]
    (tmp_path / "bad.txt").write_text("1,2,3\n1,two,3\n")
    with pytest.raises(Exception):
        sources.read_text(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "short.txt").write_text("1,2\n")
    with pytest.raises(Exception):
        sources.read_text(spark, str(tmp_path / "short.txt")).collect()
    nulls = spark.createDataFrame([(1, 2, None), (1, 3, 1.0)], SCHEMA)
    assert sources.from_dataframe(nulls, on_null="drop").count() == 1
    with pytest.raises(Exception):
        sources.from_dataframe(nulls).collect()


def test_index_codes(spark):
    rows = spark.createDataFrame([(0, 0), (3, 17), (2, (1 << 30) - 1)], "b long, i long")
    code = blocks.encode_index(F.col("b"), F.col("i"), 4)
    back = blocks.decode_index(F.col("c"), 4)
    assert all((r.b, r.i) == (r.x, r.y) for r in rows.withColumn("c", code).select("b", "i", back[0].alias("x"), back[1].alias("y")).collect())
    with pytest.raises(Exception):
        spark.createDataFrame([(4, 0)], "b long, i long").select(code).collect()


@pytest.mark.parametrize("flags", [["--als"], ["--ncg"], []])
def test_command_line(spark, tmp_path, sparse, flags):
    path = str(tmp_path / "ratings")
    sparse.select(F.concat_ws(";", "user", "item", "rating")).write.text(path)
    out = {n: str(tmp_path / n) for n in ("model", "used", "history", "errors")}
    model = cli.main(["-R", path, "-d", ";", "-f", "2", "-k", "2", "-n", "20", "-N", "2", "-M", "3", "-o", out["model"], "--saveRatings", out["used"], "-H", out["history"], "-c", out["errors"], "--unknown", *flags], spark)
    assert model.user_factors.agg(F.max("id")).first()[0] <= 20
    assert FactorModel.load(spark, out["model"]).item_factors.count() == model.item_factors.count()
    assert spark.read.parquet(out["used"]).count() == sparse.filter("user <= 20").count()
    assert spark.read.csv(out["history"], header=True).count() == 3 and spark.read.csv(out["errors"], header=True).count() == 101


def test_written_tables(spark):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from factorloom.plans.lineage import cut, drop, scratch, shared_folder

    one = cut(spark.createDataFrame([(1, [0.5], None), (2, None, "x")], "id long, v array<double>, s string"))
    two = cut(one.withColumn("id", F.col("id") + 1), one)  # the first is gone, the second is whole
    assert sorted((r.id, r.v, r.s) for r in two.collect()) == [(2, [0.5], None), (3, None, "x")]
    with pytest.raises((PySparkException, Py4JJavaError)):
        one.collect()
    assert cut(two.limit(0)).collect() == [] and cut(two.limit(0)).schema.names == ["id", "v", "s"]
    drop(two)
    assert scratch(spark).startswith(shared_folder(spark)) and scratch(spark) != scratch(spark)


def test_estimates_stay_small(spark):
    """The size a plan is thought to have doesn't grow with the rounds of a loop."""
    from factorloom.plans.lineage import cut

    df = cut(spark.range(100).select("id", F.lit(1.0).alias("x")))
    for _ in range(4):
        df = cut(df.join(df.withColumnRenamed("x", "y"), "id").join(df.withColumnRenamed("x", "z"), "id").select("id", "x"), df)
    assert int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 20


def test_numbering(spark):
    from factorloom.operators.numbering import ordinals

    values = spark.createDataFrame([(f"k{i:03}",) for i in range(200)] + [(None,)], "k string").repartition(7)
    got = {r.k: r.n for r in ordinals(values, "k", "n").collect()}
    assert got == {f"k{i:03}": i for i in range(200)} | {None: 200}


def test_objective_moves_no_vectors_twice(spark, sparse):
    """A side's sums lie where its ratings came last, its state isn't joined anew, and components travel without arrays."""
    users, items = arrays(spark, sparse, 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key, pair in (("user", (users, items)), ("item", (items, users))):
            whole = objective.gradient(sparse, key, *pair, 2, 0.1)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert whole.count("Exchange hashpartitioning") == 4  # ratings to one end and the other, the counts of both
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    both = {(r.side, r.id): r.grad for r in objective.gradients(sparse, users, items, 2, 0.1).collect()}
    for n, (key, pair) in enumerate((("user", (users, items)), ("item", (items, users)))):
        for r in objective.gradient(sparse, key, *pair, 2, 0.1).collect():
            assert both.pop((n, r.id)) == pytest.approx(r.grad, rel=1e-12)
    assert not both


def test_minimize_when_both_starts_end_at_a_maximum():
    """ncg_one_step on six copies of sf0.1: Newton's method leads from 2 and from 500 to the maximum at -323.19."""
    c = [3001140843.3308816, -587431.38448311, -869.3402931750263, 0.12644487046453684, 0.00010452309395412553]
    assert [solvers.newton(c, s) for s in (2.0, 500.0)] == pytest.approx([-323.1894052148273] * 2)
    x, value = solvers.minimize(c, [2.0, 500.0])
    assert x == pytest.approx(1813.3379436) and value < c[0]
