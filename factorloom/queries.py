"""Registered queries of the factorization engine and their DuckDB SQL.

Most work on R1, what customers ordered of each part (rating: the quantity), with
factors by whole-number arithmetic (``lattice``), so that SQL has the same inputs.
Values are compared after ``round(x * 1e4, 0) / 1e4`` (fewer digits for large sums).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.vectors import axpby, axpy, dot, lattice, lattice_sql, random_unit, scale
from factorloom.operators import blocks as B
from factorloom.operators import exchange as X
from factorloom.operators import normal_equations as N
from factorloom.operators import objective as O
from factorloom.operators.recommend import recommend
from factorloom.operators.solvers import minimize
from factorloom.plans import model as M
from factorloom.plans.lineage import cut, scratch
from factorloom.plans.trainers import train_als, train_ncg, train_pncg
from factorloom.sources import ratings as S

RIDGE, BLOCKS, ALPHA = 0.05, 4, 0.5
ITEM_SALT, P_SALT = 101, 55


def r(c: Column | str, digits: float = 1e4) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * digits, 0) / digits


def q(c: str, digits: str = "1e4") -> str:
    return f"round(({c}) * {digits}, 0) / {digits}"


def rated(spark, d) -> DataFrame:
    """R1 as a written table: its readers, the ratings and both sides' counts, don't join orders and lines anew."""
    return cut(S.customer_part(spark, d))


def side(ratings: DataFrame, key: str, k: int) -> DataFrame:
    """(id, n, factor, p) with lattice vectors."""
    return B.counts(ratings, key).select("id", F.col("n").cast("double").alias("n"), *_lattices(key, k))


def _lattices(key: str, k: int) -> list[Column]:
    salt = ITEM_SALT if key == "item" else 0
    return [lattice(F.col("id"), k, salt).alias("factor"), lattice(F.col("id"), k, salt + P_SALT).alias("p")]


def sides(ratings: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    return side(ratings, "user", k), side(ratings, "item", k)


def entries(df: DataFrame, vector: str, name: str = "value") -> DataFrame:
    """A row (id, j, value) for each component."""
    return df.select("id", F.posexplode(vector).alias("j", "v")).select("id", F.col("j").cast("long").alias("j"), r("v").alias(name))


# --- sources and layout


def read_ratings_text(spark, d):
    """Writes R1 as text and reads it with a regular expression as delimiter."""
    path = scratch(spark)
    S.customer_part(spark, d).select(F.concat_ws(" :: ", "user", "item", "rating", F.lit("more"))).write.text(path)
    return S.read_text(spark, path, "\\s*::\\s*")


def ratings_customer_part(spark, d):
    return S.customer_part(spark, d)


def ratings_part_supplier(spark, d):
    return S.part_supplier(spark, d)


def ratings_user_key(spark, d):
    return S.user_key(spark, d)


def ratings_event_type(spark, d):
    return S.user_event_type(spark, d)


def user_cutoff(spark, d):
    return S.user_cutoff(S.customer_part(spark, d), 100)


def transpose_ratings(spark, d):
    return B.transposed(S.customer_part(spark, d))


def dimensions(spark, d):
    return B.dimensions(S.customer_part(spark, d))


def rating_counts_user(spark, d):
    return B.counts(S.customer_part(spark, d), "user")


def rating_counts_item(spark, d):
    return B.counts(S.customer_part(spark, d), "item")


def rating_blocks(spark, d):
    return B.rating_blocks(S.customer_part(spark, d), BLOCKS, BLOCKS)


def out_links(spark, d):
    return B.out_links(S.customer_part(spark, d), "user", "item", BLOCKS)


def local_indices(spark, d):
    return B.local_indices(S.customer_part(spark, d), "user", "item", BLOCKS)


def csc_pointers(spark, d):
    return B.pointers(S.customer_part(spark, d), "user", BLOCKS)


def encode_index(spark, d):
    code = B.encode_index(F.col("block"), F.col("local_index"), BLOCKS)
    back = B.decode_index(F.col("code"), BLOCKS)
    return local_indices(spark, d).withColumn("code", code).select("block", "id", "code", back[0].alias("block_back"), back[1].alias("index_back"))


# --- factors and vectors


def init_lattice(spark, d):
    return entries(side(S.customer_part(spark, d), "user", 3), "factor")


def init_random(spark, d):
    """Rows only: hash-made unit vectors."""
    return entries(B.counts(S.customer_part(spark, d), "user").select("id", random_unit(F.col("id"), 5, 42, 0).alias("factor")), "factor")


def factor_scale(spark, d):
    return entries(side(S.customer_part(spark, d), "user", 3).withColumn("v", scale(2.5, F.col("factor"), 3)), "v")


def factor_axpy(spark, d):
    return entries(side(S.customer_part(spark, d), "user", 3).withColumn("v", axpy(-0.75, F.col("factor"), F.col("p"), 3)), "v")


def factor_axpby(spark, d):
    return entries(side(S.customer_part(spark, d), "user", 3).withColumn("v", axpby(0.5, F.col("factor"), 1.25, F.col("p"), 3)), "v")


def factor_dot(spark, d):
    return side(S.customer_part(spark, d), "user", 3).agg(r(F.sum(dot(F.col("factor"), F.col("p"), 3))).alias("dot"))


def factor_norm2(spark, d):
    x = F.col("factor")
    return side(S.customer_part(spark, d), "user", 3).agg(r(F.sum(dot(x, x, 3))).alias("norm_squared"), r(F.sqrt(F.sum(dot(x, x, 3)))).alias("norm"))


def embedding_norm2(spark, d):
    """The same over the embeddings, 64 components each."""
    x = F.col("v")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("v"))
    return rows.agg(r(F.sum(dot(x, x, 64))).alias("norm_squared"))


# --- normal equations


def _grams(spark, d, ray: bool):
    rows = []
    users = side(S.customer_part(spark, d), "user", 3)
    made = [N.gram(users, 3)] if not ray else N.gram_ray(users.withColumnRenamed("factor", "x"), 3)
    for i in range(3):
        for j in range(3):
            rows.append((i, j, *(float(m[i, j]) for m in made)))
    names = ["value"] if not ray else ["xx", "xp", "pp"]
    out = spark.createDataFrame(rows, "i long, j long, " + ", ".join(f"{n} double" for n in names))
    return out.select("i", "j", *(r(n).alias(n) for n in names))


def gram_matrix(spark, d):
    return _grams(spark, d, False)


def gram_ray(spark, d):
    return _grams(spark, d, True)


def normal_equations(spark, d):
    """By built-in aggregates."""
    ratings = rated(spark, d)
    sums = N.normal_sums(ratings, "user", side(ratings, "item", 3), 3)
    return sums.select("id", "n", *(r(c).alias(c) for c in sums.columns if c[1:2] == "_"))


def normal_equations_batched(spark, d):
    """By sums of Arrow batches."""
    ratings = rated(spark, d)
    sums = N.normal_equations(ratings, "user", side(ratings, "item", 3), 3)
    return sums.select("id", F.col("n").cast("long").alias("n"), *(r(F.col("g")[i]).alias(f"g_{i}") for i in range(6)), *(r(F.col("b")[i]).alias(f"b_{i}") for i in range(3)))


# --- objective


def squared_error(spark, d):
    ratings = rated(spark, d)
    return O.squared_error(ratings, *sides(ratings, 3), 3).select(r("squared_error", 10.0).alias("squared_error"), "n")


def tikhonov_norm(spark, d):
    return O.weighted_norm(side(rated(spark, d), "user", 3), 3, RIDGE).select(r("norm").alias("norm"))


def mf_cost(spark, d):
    """The objective in one plan."""
    ratings = rated(spark, d)
    users, items = sides(ratings, 3)
    error = O.squared_error(ratings, users, items, 3).select(F.col("squared_error").alias("part"))
    parts = error.union(O.weighted_norm(users, 3, RIDGE)).union(O.weighted_norm(items, 3, RIDGE))
    return parts.agg(r(F.sum("part"), 10.0).alias("cost"))


def ray_norms(spark, d):
    return O.ray_norms(side(rated(spark, d), "user", 3), 3, RIDGE).select(*(r(c).alias(c) for c in ("xx", "xp", "pp")))


def ray_coefficients(spark, d):
    ratings = rated(spark, d)
    return O.ray_sums(ratings, *sides(ratings, 3), 3).select(*(r(f"c{i}", 10.0).alias(f"c{i}") for i in range(5)))


def gradient_user(spark, d):
    ratings = rated(spark, d)
    return entries(O.gradient(ratings, "user", *sides(ratings, 3), 3, RIDGE), "grad")


def gradient_item(spark, d):
    ratings = rated(spark, d)
    users, items = sides(ratings, 3)
    return entries(O.gradient(ratings, "item", items, users, 3, RIDGE), "grad")


def gradient_norm(spark, d):
    ratings = rated(spark, d)
    users, items = sides(ratings, 3)
    g = F.col("grad")
    return O.gradients(ratings, users, items, 3, RIDGE).agg(r(F.sqrt(F.sum(dot(g, g, 3))), 100.0).alias("norm"))


# --- steps


def newton_minimize(spark, d):
    """The step along the lattice direction, by the exact line search."""
    ratings = rated(spark, d)
    alpha, _ = minimize(O.ray(ratings, *sides(ratings, 2), 2, RIDGE), [0.0, 2.0])
    return spark.createDataFrame([(alpha,)], "alpha double").select(r("alpha", 1e6).alias("alpha"))


def _routed_half(ratings: DataFrame, key: str, factors: DataFrame) -> DataFrame:
    """(id, factor): a half-step in which factors go to the blocks of ratings that need them."""
    partitions = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = X.deal(ratings, key, B.counts(ratings, key), partitions)
    out = cut(X.run(dealt, X.solving(2, RIDGE), factors).select("id", F.col("solved").alias("factor")))
    dealt.unpersist()
    return out


def als_half_step(spark, d):
    ratings = rated(spark, d)
    return entries(_routed_half(ratings, "user", side(ratings, "item", 2)), "factor")


def als_one_iter(spark, d):
    """Items from the lattice users, then users from those items."""
    ratings = rated(spark, d)
    return entries(_routed_half(ratings, "user", _routed_half(ratings, "item", side(ratings, "user", 2))), "factor")


def als_implicit_half_step(spark, d):
    ratings = rated(spark, d).withColumn("rating", F.col("rating") - 10)
    return entries(N.half_step(ratings, "user", side(ratings, "item", 2), 2, RIDGE, implicit=True, alpha=ALPHA), "factor")


def nnls_half_step(spark, d):
    ratings = rated(spark, d).withColumn("rating", F.col("rating") - 25)
    return entries(N.half_step(ratings, "user", side(ratings, "item", 2), 2, RIDGE, nonnegative=True), "factor")


def preconditioned_gradient(spark, d):
    """The users' part: the point minus its half-step."""
    ratings = rated(spark, d)
    users, items = sides(ratings, 2)
    new = N.half_step(ratings, "user", items, 2, RIDGE).select("id", F.col("factor").alias("new"))
    return entries(users.join(new, "id").withColumn("v", axpby(1.0, F.col("factor"), -1.0, F.col("new"), 2)), "v")


def preconditioned_gradient_item(spark, d):
    """The items' part: the point minus the half-step from the users' new factors."""
    ratings = rated(spark, d)
    users, items = sides(ratings, 2)
    new = N.half_step(ratings, "item", N.half_step(ratings, "user", items, 2, RIDGE), 2, RIDGE).select("id", F.col("factor").alias("new"))
    return entries(items.join(new, "id").withColumn("v", axpby(1.0, F.col("factor"), -1.0, F.col("new"), 2)), "v")


def _implicit_gradient(spark, d, key):
    ratings = rated(spark, d).withColumn("rating", F.col("rating") - 10)
    users, items = sides(ratings, 2)
    own, other = (users, items) if key == "user" else (items, users)
    return entries(O.implicit_gradient(ratings, key, own, other, 2, RIDGE, ALPHA), "grad")


def implicit_gradient_user(spark, d):
    return _implicit_gradient(spark, d, "user")


def implicit_gradient_item(spark, d):
    return _implicit_gradient(spark, d, "item")


def _preferences(spark, d):
    """R1 less 10: what is over 0 is a preference; and both sides with the numbers of their preferences."""
    ratings = rated(spark, d).withColumn("rating", F.col("rating") - 10)
    seen = F.count_if(F.col("rating") > 0).cast("double").alias("n")
    # written, because the Gram matrices, the norms and the join read them
    return ratings, *(cut(ratings.groupBy(F.col(key).alias("id")).agg(seen).select("id", "n", *_lattices(key, 2))) for key in ("user", "item"))


def implicit_cost(spark, d):
    """The implicit objective, over all pairs of users and items."""
    cost = O.implicit_cost(*_preferences(spark, d), 2, RIDGE, ALPHA)
    return spark.createDataFrame([(cost,)], "cost double").select(r("cost", 10.0).alias("cost"))


def implicit_ray_coefficients(spark, d):
    c = O.implicit_ray(*_preferences(spark, d), 2, RIDGE, ALPHA)
    return spark.createDataFrame([tuple(c)], ", ".join(f"c{i} double" for i in range(5))).select(*(r(f"c{i}", 10.0).alias(f"c{i}") for i in range(5)))


def _steps(trainer, spark, d, steps=1):
    model = trainer(S.customer_part(spark, d), rank=2, iterations=steps, ridge=RIDGE, init="lattice")
    rows = model.user_factors.select("id", F.posexplode("features").alias("j", "v"))
    return rows.select("id", F.col("j").cast("long").alias("j"), r("v", 100.0).alias("value"))


def pncg_one_step(spark, d):
    return _steps(train_pncg, spark, d)


def pncg_implicit_one_step(spark, d):
    ratings = S.customer_part(spark, d).withColumn("rating", F.col("rating") - 10)
    model = train_pncg(ratings, rank=2, iterations=1, ridge=RIDGE, init="lattice", implicit=True, alpha=ALPHA)
    rows = model.user_factors.select("id", F.posexplode("features").alias("j", "v"))
    return rows.select("id", F.col("j").cast("long").alias("j"), r("v", 100.0).alias("value"))


def ncg_one_step(spark, d):
    return _steps(train_ncg, spark, d)


def pncg_two_steps(spark, d):
    """The second step goes along a direction that beta or a restart has made."""
    return _steps(train_pncg, spark, d, 2)


def ncg_two_steps(spark, d):
    return _steps(train_ncg, spark, d, 2)


# --- trainers and models


def _history(trainer, spark, d, **more):
    """Rows only: a line for each iteration of hash-started training."""
    return trainer(S.customer_part(spark, d), rank=5, iterations=5, ridge=RIDGE, seed=1, **more).history


def train_als_history(spark, d):
    return _history(train_als, spark, d)


def train_ncg_history(spark, d):
    return _history(train_ncg, spark, d)


def train_pncg_history(spark, d):
    return _history(train_pncg, spark, d)


def train_nonnegative_history(spark, d):
    return _history(train_als, spark, d, nonnegative=True)


def train_implicit_history(spark, d):
    """Rows only: the implicit objective under conjugate gradients."""
    return train_pncg(S.user_key(spark, d), rank=4, iterations=3, ridge=RIDGE, implicit=True, alpha=ALPHA).history


def train_implicit_factors(spark, d):
    """Rows only."""
    model = train_als(S.user_key(spark, d), rank=4, iterations=3, ridge=RIDGE, implicit=True, alpha=ALPHA)
    return model.user_factors.select("id", F.posexplode("features").alias("j", "value"))


def _predicted(spark, d):
    ratings = S.customer_part(spark, d)
    users, items = (x.select("id", F.col("factor").alias("features")) for x in sides(ratings, 3))
    return M.predict(ratings, users, items, 3)


def predict(spark, d):
    return _predicted(spark, d).select("user", "item", "rating", r("prediction").alias("prediction"))


def rmse(spark, d):
    return M.errors(_predicted(spark, d)).select(r("rmse").alias("rmse"), r("max_error").alias("max_error"), "n")


def weighted_rmse(spark, d):
    return M.weighted_rmse(_predicted(spark, d)).select(r("weighted_rmse").alias("weighted_rmse"))


def _best(mine: DataFrame, others: DataFrame, seen: DataFrame) -> DataFrame:
    features = [side.select("id", F.col("factor").alias("features")) for side in (mine, others)]
    return recommend(*features, 3, 5, seen, block=64).select("user", "item", "rank", r("prediction").alias("prediction"))


def recommend_items(spark, d):
    """The five best parts of each customer that they haven't ordered."""
    ratings = rated(spark, d)
    return _best(*sides(ratings, 3), ratings)


def recommend_users(spark, d):
    """The five best customers of each part who haven't ordered it."""
    ratings = rated(spark, d)
    users, items = sides(ratings, 3)
    seen = B.transposed(ratings).select(F.col("src").alias("user"), F.col("dst").alias("item"))
    return _best(items, users, seen).select(F.col("item").alias("user"), F.col("user").alias("item"), "rank", "prediction")


QUERIES = {
    f.__name__: f
    for f in (
        read_ratings_text, ratings_customer_part, ratings_part_supplier, ratings_user_key, ratings_event_type, user_cutoff,
        transpose_ratings, dimensions, rating_counts_user, rating_counts_item, rating_blocks, out_links, local_indices,
        csc_pointers, encode_index, init_lattice, init_random, factor_scale, factor_axpy, factor_axpby, factor_dot,
        factor_norm2, embedding_norm2, gram_matrix, gram_ray, normal_equations, normal_equations_batched, squared_error,
        tikhonov_norm, mf_cost, ray_norms, ray_coefficients, gradient_user, gradient_item, gradient_norm, newton_minimize,
        als_half_step, als_one_iter, als_implicit_half_step, nnls_half_step, preconditioned_gradient,
        preconditioned_gradient_item, implicit_gradient_user, implicit_gradient_item, implicit_cost,
        implicit_ray_coefficients, pncg_one_step, pncg_implicit_one_step, train_implicit_history, ncg_one_step,
        pncg_two_steps, ncg_two_steps, train_als_history, train_ncg_history, train_pncg_history, train_nonnegative_history,
        train_implicit_factors, predict, rmse, weighted_rmse, recommend_items, recommend_users,
    )
}
QUERIES["train_als"] = QUERIES.pop("train_als_history")
QUERIES["train_ncg"] = QUERIES.pop("train_ncg_history")
QUERIES["train_pncg"] = QUERIES.pop("train_pncg_history")


# --- SQL

R1 = "SELECT o_custkey AS u, l_partkey AS i, l_quantity AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _vector(column: str, k: int, salt: int, name: str) -> str:
    return ", ".join(f"{lattice_sql(column, j, salt)} AS {name}{j}" for j in range(k))


def _base(k: int, ratings: str = R1) -> str:
    """Common tables r (ratings), us and it (id, n, x*/y*, p*/q*)."""
    return (
        f"WITH RECURSIVE r AS ({ratings}), us AS (SELECT u, count(*) AS n, {_vector('u', k, 0, 'x')}, {_vector('u', k, P_SALT, 'p')} FROM r GROUP BY u), "
        f"it AS (SELECT i, count(*) AS n, {_vector('i', k, ITEM_SALT, 'y')}, {_vector('i', k, ITEM_SALT + P_SALT, 'q')} FROM r GROUP BY i)"
    )


def _dot(a: str, b: str, k: int) -> str:
    return "(" + " + ".join(f"{a}{j} * {b}{j}" for j in range(k)) + ")"


def _rows(source: str, expressions: list[str], key: str = "u", digits: str = "1e4") -> str:
    """A row (id, j, value) for each expression over a table."""
    return " UNION ALL ".join(f"SELECT {key} AS id, CAST({j} AS BIGINT) AS j, {q(e, digits)} AS value FROM {source}" for j, e in enumerate(expressions))


def _solved(table: str, key: str, extra: str = "") -> str:
    """x0, x1 of two-by-two systems in a table (key, a00, a01, a11, b0, b1)."""
    det = "(a00 * a11 - a01 * a01)"
    return f"SELECT {key}, {extra} (a11 * b0 - a01 * b1) / {det} AS s0, (a00 * b1 - a01 * b0) / {det} AS s1 FROM {table}"


def _system(key: str, other: str, v0: str, v1: str) -> str:
    """Ridged normal equations of side ``key`` from a table of the other side's vectors."""
    join = "i" if key == "u" else "u"
    return (
        f"SELECT r.{key}, sum({v0} * {v0}) + {RIDGE} * count(*) AS a00, sum({v0} * {v1}) AS a01, sum({v1} * {v1}) + {RIDGE} * count(*) AS a11, "
        f"sum(v * {v0}) AS b0, sum(v * {v1}) AS b1 FROM r JOIN {other} USING ({join}) GROUP BY r.{key}"
    )


def _gradients(k: int, users: str = "us", items: str = "it", more: str = "") -> str:
    """Tables gu (u, g*) and gi (i, g*) at the points of two tables; ``more`` ends the new tables' names."""
    off = f"({_dot('x', 'y', k)} - v)"
    met = f"(SELECT r.u, r.i, r.v, {users}.* EXCLUDE (u, n), {items}.* EXCLUDE (i, n), {users}.n AS nu, {items}.n AS ni FROM r JOIN {users} USING (u) JOIN {items} USING (i))"
    gu = f"gu{more} AS (SELECT u, {', '.join(f'2 * sum({off} * y{j}) + 2 * {RIDGE} * any_value(nu) * any_value(x{j}) AS g{j}' for j in range(k))} FROM {met} GROUP BY u)"
    gi = f"gi{more} AS (SELECT i, {', '.join(f'2 * sum({off} * x{j}) + 2 * {RIDGE} * any_value(ni) * any_value(y{j}) AS g{j}' for j in range(k))} FROM {met} GROUP BY i)"
    return f"{gu}, {gi}"


def _ray(k: int, users: str, items: str, name: str = "c") -> str:
    """A one-row table of the full coefficients c0 .. c4 along (x, p), (y, q) of two tables."""
    e, s, t = f"({_dot('x', 'y', k)} - v)", f"({_dot('x', 'q', k)} + {_dot('p', 'y', k)})", _dot("p", "q", k)
    norms = lambda table, a, b: f"(SELECT {RIDGE} * sum(n * {_dot(a, b, k)}) FROM {table})"
    return (
        f"{name}_est AS (SELECT {e} AS e, {s} AS s, {t} AS t FROM r JOIN {users} USING (u) JOIN {items} USING (i)), "
        f"{name} AS (SELECT sum(e * e) + {norms(users, 'x', 'x')} + {norms(items, 'y', 'y')} AS c0, sum(2 * e * s) + 2 * ({norms(users, 'x', 'p')} + {norms(items, 'y', 'q')}) AS c1, "
        f"sum(s * s + 2 * e * t) + {norms(users, 'p', 'p')} + {norms(items, 'q', 'q')} AS c2, sum(2 * s * t) AS c3, sum(t * t) AS c4 FROM {name}_est)"
    )


def _minimum(starts: list[str], name: str = "c", more: str = "") -> str:
    """A one-row table ``best`` (alpha): Newton's method on the slope from each start, the lowest minimum."""
    slope = "(c1 + z * (2 * c2 + z * (3 * c3 + z * 4 * c4)))"
    bend = "(2 * c2 + z * (6 * c3 + z * 12 * c4))"
    first = " UNION ALL ".join(f"SELECT 0 AS step, {n} AS start, CAST({s} AS DOUBLE) AS z" for n, s in enumerate(starts))
    return (
        f"walk{more} AS ({first} UNION ALL SELECT step + 1, start, z - {slope} / {bend} FROM walk{more}, {name} WHERE step < 11 AND {bend} <> 0), "
        f"best{more} AS (SELECT z AS alpha FROM walk{more}, {name} WHERE step = 11 AND {bend} >= 0 ORDER BY c0 + z * (c1 + z * (c2 + z * (c3 + z * c4))), start LIMIT 1)"
    )


def oracles() -> dict[str, str]:
    k = 3
    out = {
        "read_ratings_text": R1.replace(" u,", " user,").replace(" i,", " item,").replace(" v ", " rating "),
        "ratings_part_supplier": "SELECT l_partkey AS user, l_suppkey AS item, l_quantity AS rating FROM lineitem",
        "ratings_user_key": "SELECT user_id AS user, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, value AS rating FROM events",
        "ratings_event_type": "SELECT user_id AS user, CAST(dense_rank() OVER (ORDER BY event_type) AS BIGINT) AS item, value AS rating FROM events",
        "transpose_ratings": f"SELECT i AS src, u AS dst, v AS rating FROM ({R1})",
        "dimensions": f"SELECT count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items FROM ({R1})",
        "rating_counts_user": f"SELECT u AS id, count(*) AS n FROM ({R1}) GROUP BY u",
        "rating_counts_item": f"SELECT i AS id, count(*) AS n FROM ({R1}) GROUP BY i",
        "rating_blocks": f"SELECT u % {BLOCKS} AS user_block, i % {BLOCKS} AS item_block, count(*) AS n, sum(v) AS total FROM ({R1}) GROUP BY ALL",
        "out_links": f"SELECT DISTINCT u AS id, i % {BLOCKS} AS block FROM ({R1})",
        "local_indices": f"SELECT block, id, dense_rank() OVER (PARTITION BY block ORDER BY id) - 1 AS local_index FROM (SELECT DISTINCT u % {BLOCKS} AS block, i AS id FROM ({R1}))",
        "csc_pointers": f'SELECT u % {BLOCKS} AS block, u AS id, CAST(sum(n) OVER w - n AS BIGINT) AS "begin", CAST(sum(n) OVER w AS BIGINT) AS "end" FROM (SELECT u, count(*) AS n FROM ({R1}) GROUP BY u) WINDOW w AS (PARTITION BY u % {BLOCKS} ORDER BY u)',
    }
    out["ratings_customer_part"] = out["read_ratings_text"]
    out["user_cutoff"] = out["read_ratings_text"] + " WHERE o_custkey <= 100"
    bits = B.index_bits(BLOCKS)
    out["encode_index"] = f"SELECT block, id, (block << {bits}) | local_index AS code, block AS block_back, local_index AS index_back FROM ({out['local_indices']})"

    base = _base(k)
    users = f"({base} SELECT * FROM us)"
    out["init_lattice"] = _rows(users, [f"x{j}" for j in range(k)])
    out["factor_scale"] = _rows(users, [f"2.5e0 * x{j}" for j in range(k)])
    out["factor_axpy"] = _rows(users, [f"-0.75e0 * x{j} + p{j}" for j in range(k)])
    out["factor_axpby"] = _rows(users, [f"0.5e0 * x{j} + 1.25e0 * p{j}" for j in range(k)])
    out["factor_dot"] = f"{base} SELECT {q('sum(' + _dot('x', 'p', k) + ')')} AS dot FROM us"
    square = f"sum({_dot('x', 'x', k)})"
    out["factor_norm2"] = f"{base} SELECT {q(square)} AS norm_squared, {q(f'sqrt({square})')} AS norm FROM us"
    out["embedding_norm2"] = f"SELECT {q('sum(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * z)))')} AS norm_squared FROM embeddings"
    out["gram_matrix"] = base + " " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, {q(f'sum(x{i} * x{j})')} AS value FROM us" for i in range(k) for j in range(k))
    out["gram_ray"] = base + " " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, {q(f'sum(x{i} * x{j})')} AS xx, {q(f'sum(x{i} * p{j} + p{i} * x{j})')} AS xp, {q(f'sum(p{i} * p{j})')} AS pp FROM us" for i in range(k) for j in range(k))
    pairs = [(i, j) for j in range(k) for i in range(j + 1)]
    sums = ", ".join([*(f"{q(f'sum(y{i} * y{j})')} AS g_{n}" for n, (i, j) in enumerate(pairs)), *(f"{q(f'sum(y{j} * v)')} AS b_{j}" for j in range(k))])
    out["normal_equations"] = out["normal_equations_batched"] = f"{base} SELECT u AS id, count(*) AS n, {sums} FROM r JOIN it USING (i) GROUP BY u"

    met = "r JOIN us USING (u) JOIN it USING (i)"
    off = f"({_dot('x', 'y', k)} - v)"
    out["squared_error"] = f"{base} SELECT {q(f'sum({off} * {off})', '10e0')} AS squared_error, count(*) AS n FROM {met}"
    norm = lambda table, a, b: f"(SELECT {RIDGE} * sum(n * {_dot(a, b, k)}) FROM {table})"
    out["tikhonov_norm"] = f"{base} SELECT {q(norm('us', 'x', 'x'))} AS norm"
    out["mf_cost"] = f"{base} SELECT {q(f'(SELECT sum({off} * {off}) FROM {met}) + ' + norm('us', 'x', 'x') + ' + ' + norm('it', 'y', 'y'), '10e0')} AS cost"
    out["ray_norms"] = f"{base} SELECT {q(norm('us', 'x', 'x'))} AS xx, {q(norm('us', 'x', 'p'))} AS xp, {q(norm('us', 'p', 'p'))} AS pp"
    s, t = f"({_dot('x', 'q', k)} + {_dot('p', 'y', k)})", _dot("p", "q", k)
    c = [f"sum({off} * {off})", f"sum(2 * {off} * {s})", f"sum({s} * {s} + 2 * {off} * {t})", f"sum(2 * {s} * {t})", f"sum({t} * {t})"]
    out["ray_coefficients"] = f"{base} SELECT {', '.join(f'{q(e, "10e0")} AS c{i}' for i, e in enumerate(c))} FROM {met}"
    grads = f"{base}, {_gradients(k)}"
    out["gradient_user"] = grads + " " + _rows("gu", [f"g{j}" for j in range(k)])
    out["gradient_item"] = grads + " " + _rows("gi", [f"g{j}" for j in range(k)], "i")
    both = f"(SELECT sum({_dot('g', 'g', k)}) FROM gu) + (SELECT sum({_dot('g', 'g', k)}) FROM gi)"
    out["gradient_norm"] = f"{grads} SELECT {q(f'sqrt({both})', '100e0')} AS norm"

    base = _base(2)
    values = ["s0", "s1"]
    out["newton_minimize"] = f"{base}, {_ray(2, 'us', 'it')}, {_minimum(['0', '2'])} SELECT {q('alpha', '1e6')} AS alpha FROM best"
    half = f"{base}, sys AS ({_system('u', 'it', 'y0', 'y1')}), new AS ({_solved('sys', 'u')})"
    out["als_half_step"] = half + " " + _rows("new", values)
    whole = f"{base}, isys AS ({_system('i', 'us', 'x0', 'x1')}), inew AS ({_solved('isys', 'i')}), usys AS ({_system('u', 'inew', 's0', 's1')}), unew AS ({_solved('usys', 'u')})"
    out["als_one_iter"] = whole + " " + _rows("unew", values)
    out["preconditioned_gradient"] = half + ", g AS (SELECT us.u, x0 - s0 AS g0, x1 - s1 AS g1 FROM us JOIN new USING (u)) " + _rows("g", ["g0", "g1"])
    out["preconditioned_gradient_item"] = (
        f"{half}, isys AS ({_system('i', 'new', 's0', 's1')}), inew AS ({_solved('isys', 'i')}), g AS (SELECT it.i, y0 - s0 AS g0, y1 - s1 AS g1 FROM it JOIN inew USING (i)) " + _rows("g", ["g0", "g1"], "i")
    )
    signed = R1.replace("l_quantity AS v", "l_quantity - 10 AS v")
    for key, mine, theirs, own, other in (("u", "x", "y", "us", "it"), ("i", "y", "x", "it", "us")):
        sure = f"2 * (1 + {ALPHA}e0 * abs(v)) * ({_dot('x', 'y', 2)} - CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END)"
        whole_of = f"yy AS (SELECT sum({theirs}0 * {theirs}0) AS a, sum({theirs}0 * {theirs}1) AS b, sum({theirs}1 * {theirs}1) AS c FROM {other})"
        part = f"part AS (SELECT r.{key}, sum({sure} * {theirs}0) AS t0, sum({sure} * {theirs}1) AS t1 FROM r JOIN us USING (u) JOIN it USING (i) GROUP BY r.{key})"
        g = f"g AS (SELECT {key}, t0 + 2 * {RIDGE} * {mine}0 + 2 * (a * {mine}0 + b * {mine}1) AS g0, t1 + 2 * {RIDGE} * {mine}1 + 2 * (b * {mine}0 + c * {mine}1) AS g1 FROM part JOIN {own} USING ({key}), yy)"
        out["implicit_gradient_" + ("user" if key == "u" else "item")] = f"{_base(2, signed)}, {whole_of}, {part}, {g} " + _rows("g", ["g0", "g1"], key)
    more = f"CASE WHEN v > 0 THEN {ALPHA}e0 * abs(v) ELSE 0 END"
    out["als_implicit_half_step"] = (
        f"{_base(2, signed)}, yy AS (SELECT sum(y0 * y0) AS a, sum(y0 * y1) AS b, sum(y1 * y1) AS c FROM it), part AS (SELECT u, {more} AS m, v > 0 AS seen, y0, y1 FROM r JOIN it USING (i)), "
        f"sys AS (SELECT u, sum(m * y0 * y0) + any_value(a) + {RIDGE} * count(*) FILTER (seen) AS a00, sum(m * y0 * y1) + any_value(b) AS a01, sum(m * y1 * y1) + any_value(c) + {RIDGE} * count(*) FILTER (seen) AS a11, "
        f"sum(CASE WHEN seen THEN (1 + m) * y0 ELSE 0 END) AS b0, sum(CASE WHEN seen THEN (1 + m) * y1 ELSE 0 END) AS b1 FROM part, yy GROUP BY u), new AS ({_solved('sys', 'u')}) " + _rows("new", values)
    )
    # the implicit objective over all pairs; n counts preferences
    liked = _base(2, signed).replace("count(*) AS n", "count(*) FILTER (v > 0) AS n")
    all_pairs = lambda users, items: (
        f"wide_pairs AS (SELECT {_dot('x', 'y', 2)} AS e, {_dot('x', 'q', 2)} + {_dot('p', 'y', 2)} AS s, {_dot('p', 'q', 2)} AS t FROM {users}, {items}), "
        f"rated AS (SELECT 1 + {ALPHA}e0 * v AS c, {_dot('x', 'y', 2)} AS e, {_dot('x', 'q', 2)} + {_dot('p', 'y', 2)} AS s, {_dot('p', 'q', 2)} AS t FROM r JOIN {users} USING (u) JOIN {items} USING (i) WHERE v > 0), "
        "wide AS (SELECT sum(e * e) AS w0, sum(2 * e * s) AS w1, sum(s * s + 2 * e * t) AS w2, sum(2 * s * t) AS w3, sum(t * t) AS w4 FROM wide_pairs), "
        "part AS (SELECT sum(c * (e - 1) * (e - 1) - e * e) AS d0, sum(2 * c * (e - 1) * s - 2 * e * s) AS d1, sum(c * (s * s + 2 * (e - 1) * t) - s * s - 2 * e * t) AS d2, sum(2 * (c - 1) * s * t) AS d3, sum((c - 1) * t * t) AS d4 FROM rated), "
        f"c AS (SELECT w0 + d0 + {norm(users, 'x', 'x')} + {norm(items, 'y', 'y')} AS c0, w1 + d1 + 2 * ({norm(users, 'x', 'p')} + {norm(items, 'y', 'q')}) AS c1, "
        f"w2 + d2 + {norm(users, 'p', 'p')} + {norm(items, 'q', 'q')} AS c2, w3 + d3 AS c3, w4 + d4 AS c4 FROM wide, part)"
    )
    norm = lambda table, a, b: f"(SELECT {RIDGE} * sum(n * {_dot(a, b, 2)}) FROM {table})"
    out["implicit_cost"] = f"{liked}, {all_pairs('us', 'it')} SELECT {q('c0', '10e0')} AS cost FROM c"
    out["implicit_ray_coefficients"] = f"{liked}, {all_pairs('us', 'it')} SELECT {', '.join(f'{q(f"c{j}", "10e0")} AS c{j}' for j in range(5))} FROM c"
    sure = f"CASE WHEN v > 0 THEN {ALPHA}e0 * v ELSE 0 END"
    wants = lambda key, table, a, b, gram: (
        f"SELECT r.{key}, sum({sure} * {a} * {a}) + any_value(ya) + {RIDGE} * count(*) FILTER (v > 0) AS a00, sum({sure} * {a} * {b}) + any_value(yb) AS a01, sum({sure} * {b} * {b}) + any_value(yc) + {RIDGE} * count(*) FILTER (v > 0) AS a11, "
        f"sum(CASE WHEN v > 0 THEN (1 + {sure}) * {a} ELSE 0 END) AS b0, sum(CASE WHEN v > 0 THEN (1 + {sure}) * {b} ELSE 0 END) AS b1 FROM r JOIN {table} USING ({'i' if key == 'u' else 'u'}), {gram} GROUP BY r.{key}"
    )
    all_of = lambda name, table, a, b: f"{name} AS (SELECT sum({a} * {a}) AS ya, sum({a} * {b}) AS yb, sum({b} * {b}) AS yc FROM {table})"
    out["pncg_implicit_one_step"] = (
        f"{liked}, {all_of('yy', 'it', 'y0', 'y1')}, usys AS ({wants('u', 'it', 'y0', 'y1', 'yy')}), unew AS ({_solved('usys', 'u')}), {all_of('xx', 'unew', 's0', 's1')}, isys AS ({wants('i', 'unew', 's0', 's1', 'xx')}), inew AS ({_solved('isys', 'i')}), "
        "ud AS (SELECT u, n, x0, x1, s0 - x0 AS p0, s1 - x1 AS p1 FROM us JOIN unew USING (u)), id AS (SELECT i, n, y0, y1, s0 - y0 AS q0, s1 - y1 AS q1 FROM it JOIN inew USING (i)), "
        f"{all_pairs('ud', 'id')}, {_minimum(['0', '2'])}, done AS (SELECT * FROM ud, best) " + _rows("done", ["CAST(CAST(x0 + alpha * p0 AS FLOAT) AS DOUBLE)", "CAST(CAST(x1 + alpha * p1 AS FLOAT) AS DOUBLE)"], digits="100e0")
    )
    low = R1.replace("l_quantity AS v", "l_quantity - 25 AS v")
    # of the four sets of components that may be above 0, the one whose solution is feasible and lowest
    value = "(a00 * z0 * z0 + 2 * a01 * z0 * z1 + a11 * z1 * z1) / 2 - b0 * z0 - b1 * z1"
    out["nnls_half_step"] = (
        f"{_base(2, low)}, sys AS ({_system('u', 'it', 'y0', 'y1')}), tried AS (SELECT u, a00, a01, a11, b0, b1, 0e0 AS z0, 0e0 AS z1 FROM sys UNION ALL SELECT u, a00, a01, a11, b0, b1, b0 / a00, 0 FROM sys "
        f"UNION ALL SELECT u, a00, a01, a11, b0, b1, 0, b1 / a11 FROM sys UNION ALL SELECT u, a00, a01, a11, b0, b1, (a11 * b0 - a01 * b1) / (a00 * a11 - a01 * a01), (a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01) FROM sys), "
        f"new AS (SELECT u, arg_min(z0, {value}) AS s0, arg_min(z1, {value}) AS s1 FROM tried WHERE z0 >= 0 AND z1 >= 0 GROUP BY u) " + _rows("new", values)
    )
    # one step of each gradient method: the point moved by the best step along its first direction
    moved = ["CAST(CAST(x0 + alpha * p0 AS FLOAT) AS DOUBLE)", "CAST(CAST(x1 + alpha * p1 AS FLOAT) AS DOUBLE)"]
    start = _base(2)
    pre = (
        f"{start}, usys AS ({_system('u', 'it', 'y0', 'y1')}), unew AS ({_solved('usys', 'u')}), isys AS ({_system('i', 'unew', 's0', 's1')}), inew AS ({_solved('isys', 'i')}), "
        "ud AS (SELECT u, n, x0, x1, s0 - x0 AS p0, s1 - x1 AS p1 FROM us JOIN unew USING (u)), id AS (SELECT i, n, y0, y1, s0 - y0 AS q0, s1 - y1 AS q1 FROM it JOIN inew USING (i))"
    )
    out["pncg_one_step"] = f"{pre}, {_ray(2, 'ud', 'id')}, {_minimum(['0', '2'])}, done AS (SELECT * FROM ud, best) " + _rows("done", moved, digits="100e0")
    plain = (
        f"{start}, {_gradients(2)}, len AS (SELECT sqrt((SELECT sum({_dot('g', 'g', 2)}) FROM gu) + (SELECT sum({_dot('g', 'g', 2)}) FROM gi)) AS len), "
        "ud AS (SELECT u, n, x0, x1, -g0 / len AS p0, -g1 / len AS p1 FROM us JOIN gu USING (u), len), id AS (SELECT i, n, y0, y1, -g0 / len AS q0, -g1 / len AS q1 FROM it JOIN gi USING (i), len)"
    )
    out["ncg_one_step"] = f"{plain}, {_ray(2, 'ud', 'id')}, {_minimum(['2', '500'])}, done AS (SELECT * FROM ud, best) " + _rows("done", moved, digits="100e0")

    # the second step: the point moved, the direction made anew by beta, or restarted where it is negative
    at = lambda users, items: (
        f"us1 AS (SELECT u, n, x0 + alpha * p0 AS x0, x1 + alpha * p1 AS x1, {users} FROM ud, best), it1 AS (SELECT i, n, y0 + alpha * q0 AS y0, y1 + alpha * q1 AS y1, {items} FROM id, best)"
    )
    over = lambda a, b: f"((SELECT sum({_dot(a, b, 2)}) FROM ua) + (SELECT sum({_dot(a, b, 2)}) FROM ia))"
    last = ["CAST(CAST(x0 + alpha * p0 AS FLOAT) AS DOUBLE)", "CAST(CAST(x1 + alpha * p1 AS FLOAT) AS DOUBLE)"]
    out["pncg_two_steps"] = (
        f"{pre}, {_ray(2, 'ud', 'id')}, {_minimum(['0', '2'])}, {_gradients(2)}, {at('p0 AS o0, p1 AS o1', 'q0 AS o0, q1 AS o1')}, "
        f"usys1 AS ({_system('u', 'it1', 'y0', 'y1')}), unew1 AS ({_solved('usys1', 'u')}), isys1 AS ({_system('i', 'unew1', 's0', 's1')}), inew1 AS ({_solved('isys1', 'i')}), {_gradients(2, 'us1', 'it1', '1')}, "
        "ua AS (SELECT us1.*, x0 - s0 AS d0, x1 - s1 AS d1, gu1.g0, gu1.g1, gu.g0 AS f0, gu.g1 AS f1 FROM us1 JOIN unew1 USING (u) JOIN gu1 USING (u) JOIN gu USING (u)), "
        "ia AS (SELECT it1.*, y0 - s0 AS d0, y1 - s1 AS d1, gi1.g0, gi1.g1, gi.g0 AS f0, gi.g1 AS f1 FROM it1 JOIN inew1 USING (i) JOIN gi1 USING (i) JOIN gi USING (i)), "
        f"be AS (SELECT ({over('g', 'd')} + {over('g', 'o')}) / -{over('f', 'o')} AS beta), bm AS (SELECT CASE WHEN beta < 0 OR alpha = 0 THEN 0e0 ELSE beta END AS beta FROM be, best), "
        "ud1 AS (SELECT u, n, x0, x1, beta * o0 - d0 AS p0, beta * o1 - d1 AS p1 FROM ua, bm), id1 AS (SELECT i, n, y0, y1, beta * o0 - d0 AS q0, beta * o1 - d1 AS q1 FROM ia, bm), "
        f"{_ray(2, 'ud1', 'id1', 'c1')}, {_minimum(['0', '2'], 'c1', '1')}, done AS (SELECT * FROM ud1, best1) " + _rows("done", last, digits="100e0")
    )
    out["ncg_two_steps"] = (
        f"{plain}, {_ray(2, 'ud', 'id')}, {_minimum(['2', '500'])}, {at('p0 AS o0, p1 AS o1', 'q0 AS o0, q1 AS o1')}, {_gradients(2, 'us1', 'it1', '1')}, "
        "ua AS (SELECT us1.*, gu1.g0, gu1.g1, gu.g0 AS f0, gu.g1 AS f1 FROM us1 JOIN gu1 USING (u) JOIN gu USING (u)), ia AS (SELECT it1.*, gi1.g0, gi1.g1, gi.g0 AS f0, gi.g1 AS f1 FROM it1 JOIN gi1 USING (i) JOIN gi USING (i)), "
        f"be AS (SELECT ({over('g', 'g')} - {over('g', 'f')}) / {over('f', 'f')} AS beta), bm AS (SELECT CASE WHEN beta < 0 OR alpha = 0 THEN 0e0 ELSE beta END AS beta FROM be, best), "
        "raw AS (SELECT u, n, x0, x1, -beta * f0 - g0 AS p0, -beta * f1 - g1 AS p1 FROM ua, bm), iraw AS (SELECT i, n, y0, y1, -beta * f0 - g0 AS q0, -beta * f1 - g1 AS q1 FROM ia, bm), "
        f"len1 AS (SELECT sqrt((SELECT sum({_dot('p', 'p', 2)}) FROM raw) + (SELECT sum({_dot('q', 'q', 2)}) FROM iraw)) AS len), "
        "ud1 AS (SELECT u, n, x0, x1, p0 / len AS p0, p1 / len AS p1 FROM raw, len1), id1 AS (SELECT i, n, y0, y1, q0 / len AS q0, q1 / len AS q1 FROM iraw, len1), "
        f"{_ray(2, 'ud1', 'id1', 'c1')}, {_minimum(['(SELECT 2 * abs(alpha) FROM best)', '500'], 'c1', '1')}, done AS (SELECT * FROM ud1, best1) " + _rows("done", last, digits="100e0")
    )

    base = _base(k)
    value = _dot("x", "y", k)
    out["predict"] = f"{base} SELECT r.u AS user, r.i AS item, v AS rating, {q(value)} AS prediction FROM {met}"
    out["rmse"] = f"{base} SELECT {q(f'sqrt(avg({off} * {off}))')} AS rmse, {q(f'max(abs({off}))')} AS max_error, count(*) AS n FROM {met}"
    miss = f"((CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END) - {value})"
    out["weighted_rmse"] = f"{base} SELECT {q(f'sqrt(sum((1 + abs(v)) * {miss} * {miss}) / sum(1 + abs(v)))')} AS weighted_rmse FROM {met}"
    for name, key, other in (("recommend_items", "u", "i"), ("recommend_users", "i", "u")):
        pairs = f"SELECT u, i, {value} AS s, row_number() OVER (PARTITION BY {key} ORDER BY {value} DESC, {other}) AS place FROM us, it WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = us.u AND r.i = it.i)"
        out[name] = f"{base}, best AS ({pairs} QUALIFY place <= 5) SELECT u AS user, i AS item, CAST(place AS INTEGER) AS rank, {q('s')} AS prediction FROM best"
    return out
