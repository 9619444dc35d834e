"""The objective, its gradient and its restriction to a ray, each one pass over the ratings.

f = sum over ratings of (x.y - r)^2 + ridge * (sum over users of n |x|^2 + the same of items)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.vectors import dot
from factorloom.operators.normal_equations import gram, gram_ray


def observed(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int, columns: tuple[str, ...] = ("factor",), last: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """Ratings with the vectors of both their ends, named u_<column> and i_<column>.

    The ratings travel to the end that isn't ``last`` by themselves and to the other with one end's components, which are
    columns of their own on the way: an array of three doubles takes twice their room. They then lie by ``last``, so what is summed up
    for that side doesn't move again. keep: plain columns of the last side that come along under their names.
    """
    for key, side in sorted((("user", users), ("item", items)), key=lambda end: end[0] == last):
        flat = [F.col(c)[j].alias(f"{key[0]}_{c}_{j}") for c in columns for j in range(rank)]
        ratings = ratings.join(side.select(F.col("id").alias(key), *flat, *(keep if key == last else ())), key)
    vectors = [F.array(*(F.col(f"{end}_{c}_{j}") for j in range(rank))).alias(f"{end}_{c}") for end in "ui" for c in columns]
    return ratings.select("user", "item", "rating", *vectors, *keep)


def squared_error(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int) -> Column | DataFrame:
    """One row (squared_error, n)."""
    off = dot(F.col("u_factor"), F.col("i_factor"), rank) - F.col("rating")
    return observed(ratings, users, items, rank).agg(F.sum(off * off).alias("squared_error"), F.count("*").alias("n"))


def weighted_norm(side: DataFrame, rank: int, ridge: float) -> DataFrame:
    """One row (norm): ridge times the sum of n |factor|^2 over rows (id, n, factor)."""
    return side.agg((F.lit(float(ridge)) * F.sum(F.col("n") * dot(F.col("factor"), F.col("factor"), rank))).alias("norm"))


def ray_norms(side: DataFrame, rank: int, ridge: float) -> DataFrame:
    """One row (xx, xp, pp): ridge times the sums of n x.x, n x.p and n p.p over rows (id, n, factor, p)."""
    x, p = F.col("factor"), F.col("p")
    return side.agg(*((F.lit(float(ridge)) * F.sum(F.col("n") * dot(a, b, rank))).alias(name) for name, a, b in (("xx", x, x), ("xp", x, p), ("pp", p, p))))


def cost(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int, ridge: float) -> float:
    parts = [squared_error(ratings, users, items, rank).select(F.col("squared_error").alias("part")), *(weighted_norm(side, rank, ridge) for side in (users, items))]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.sum("part")).first()[0] or 0.0


def ray_sums(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int) -> DataFrame:
    """One row c0 .. c4: the squared error at (x + t p, y + t q) as a polynomial of t."""
    x, p, y, q = (F.col(c) for c in ("u_factor", "u_p", "i_factor", "i_p"))
    parts = observed(ratings, users, items, rank, ("factor", "p")).select((dot(x, y, rank) - F.col("rating")).alias("e"), (dot(x, q, rank) + dot(p, y, rank)).alias("s"), dot(p, q, rank).alias("t"))
    e, s, t = F.col("e"), F.col("s"), F.col("t")
    return parts.agg(F.sum(e * e).alias("c0"), F.sum(2 * e * s).alias("c1"), F.sum(s * s + 2 * e * t).alias("c2"), F.sum(2 * s * t).alias("c3"), F.sum(t * t).alias("c4"))


def ray(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int, ridge: float, doubled: bool = False) -> list[float]:
    """Coefficients of f along a ray, from one job. doubled: count the direction's norm twice, as some published runs do."""
    zero = F.lit(0.0)
    parts = ray_sums(ratings, users, items, rank)
    for side in (users, items):
        norms = ray_norms(side, rank, ridge)
        parts = parts.union(norms.select(F.col("xx").alias("c0"), (2 * F.col("xp")).alias("c1"), ((2 if doubled else 1) * F.col("pp")).alias("c2"), zero.alias("c3"), zero.alias("c4")))
    return [v or 0.0 for v in parts.agg(*(F.sum(f"c{i}") for i in range(5))).first()]


def gradient(ratings: DataFrame, key: str, own: DataFrame, other: DataFrame, rank: int, ridge: float) -> DataFrame:
    """(id, grad) of one side by built-in aggregates; own: (id, n, factor), other: (id, factor)."""
    users, items = (own, other) if key == "user" else (other, own)
    mine, theirs = ("u_factor", "i_factor") if key == "user" else ("i_factor", "u_factor")
    off = dot(F.col("u_factor"), F.col("i_factor"), rank) - F.col("rating")
    met = observed(ratings, users, items, rank, last=key, keep=("n",)).withColumn("off", off)
    sums = met.groupBy(F.col(key).alias("id")).agg(*(F.sum(F.col("off") * F.col(theirs)[j]).alias(f"s_{j}") for j in range(rank)), F.any_value("n").alias("n"), *(F.any_value(F.col(mine)[j]).alias(f"x_{j}") for j in range(rank)))
    return sums.select("id", F.array(*(F.lit(2.0) * F.col(f"s_{j}") + F.lit(2.0 * ridge) * F.col("n") * F.col(f"x_{j}") for j in range(rank))).alias("grad"))


def gradients(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int, ridge: float) -> DataFrame:
    """(side, id, grad) of both sides from one pass, the users' side 0; users, items: (id, n, factor)."""
    off = dot(F.col("u_factor"), F.col("i_factor"), rank) - F.col("rating")
    met = observed(ratings, users, items, rank).withColumn("off", off)
    part = lambda side, key, theirs: F.struct(F.lit(side).alias("side"), F.col(key).alias("id"), *((F.col("off") * F.col(theirs)[j]).alias(f"s_{j}") for j in range(rank)))
    each = met.select(F.inline(F.array(part(0, "user", "i_factor"), part(1, "item", "u_factor"))))
    sums = each.groupBy("side", "id").agg(*(F.sum(f"s_{j}").alias(f"s_{j}") for j in range(rank)))
    states = users.select(F.lit(0).alias("side"), "id", "n", "factor").union(items.select(F.lit(1), "id", "n", "factor"))
    return sums.join(states, ["side", "id"]).select("side", "id", F.array(*(F.lit(2.0) * F.col(f"s_{j}") + F.lit(2.0 * ridge) * F.col("n") * F.col("factor")[j] for j in range(rank))).alias("grad"))


def implicit_gradient(ratings: DataFrame, key: str, own: DataFrame, other: DataFrame, rank: int, ridge: float, alpha: float) -> DataFrame:
    """(id, grad) of one side for implicit ratings: preferences p = [r > 0] seen with confidence c = 1 + alpha |r|.

    The sum of 2 c (x.y - p) y over the ratings, plus 2 ridge x (not weighted by count) and 2 Y'Y x with all of the other
    side's factors; own: (id, factor), other: (id, factor).
    """
    users, items = (own, other) if key == "user" else (other, own)
    mine, theirs = ("u_factor", "i_factor") if key == "user" else ("i_factor", "u_factor")
    whole = gram(other, rank)
    off = (1 + F.lit(float(alpha)) * F.abs("rating")) * (dot(F.col("u_factor"), F.col("i_factor"), rank) - F.when(F.col("rating") > 0, 1.0).otherwise(0.0))
    met = observed(ratings, users, items, rank, last=key).withColumn("off", off)
    sums = met.groupBy(F.col(key).alias("id")).agg(*(F.sum(F.col("off") * F.col(theirs)[j]).alias(f"s_{j}") for j in range(rank)), *(F.any_value(F.col(mine)[j]).alias(f"x_{j}") for j in range(rank)))
    x = [F.col(f"x_{j}") for j in range(rank)]
    pulled = [dot([F.lit(float(v)) for v in whole[j]], x, rank) for j in range(rank)]
    return sums.select("id", F.array(*(2.0 * (F.col(f"s_{j}") + F.lit(float(ridge)) * x[j] + pulled[j]) for j in range(rank))).alias("grad"))


def implicit_parts(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int, alpha: float) -> DataFrame:
    """One row: what the seen preferences add to the sum of (x.y)^2 over all pairs, and their number.

    A rating over 0 is a preference of 1 with confidence c = 1 + alpha r, all other pairs are preferences of 0 with
    confidence 1: the sum of c (x.y - 1)^2 - (x.y)^2.
    """
    z, c = dot(F.col("u_factor"), F.col("i_factor"), rank), 1 + F.lit(float(alpha)) * F.col("rating")
    return observed(ratings.filter("rating > 0"), users, items, rank).agg(F.sum(c * (z - 1) * (z - 1) - z * z).alias("correction"), F.count("*").alias("n"))


def implicit_cost(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int, ridge: float, alpha: float) -> float:
    """The implicit objective over all pairs of users and items, rated or not, without listing them.

    The sum of (x.y)^2 over all pairs is the trace of the product of both sides' Gram matrices; only rated pairs are joined.
    users, items: (id, n, factor) with n the ratings over 0, of all that count as known.
    """
    seen = implicit_parts(ratings, users, items, rank, alpha).select(F.col("correction").alias("part"))
    for side in (users, items):
        seen = seen.union(weighted_norm(side, rank, ridge))
    return float((gram(users, rank) * gram(items, rank)).sum()) + (seen.agg(F.sum("part")).first()[0] or 0.0)


def whole_ray(users: DataFrame, items: DataFrame, rank: int) -> list[float]:
    """c0 .. c4 of the sum of ((x + t p).(y + t q))^2 over all pairs: products of the Gram matrices along the ray.

    users, items: (id, factor, p).
    """
    a, b = ([np.asarray(m) for m in gram_ray(side, rank, "factor", "p")] for side in (users, items))
    c = [0.0] * 5
    for i in range(3):
        for j in range(3):
            c[i + j] += float((a[i] * b[j]).sum())
    return c


def implicit_ray(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int, ridge: float, alpha: float) -> list[float]:
    """Coefficients of the implicit objective along a ray; users, items: (id, n, factor, p)."""
    x, p, y, q = (F.col(c) for c in ("u_factor", "u_p", "i_factor", "i_p"))
    met = observed(ratings.filter("rating > 0"), users, items, rank, ("factor", "p")).select(
        (1 + F.lit(float(alpha)) * F.col("rating")).alias("c"), dot(x, y, rank).alias("z0"), (dot(x, q, rank) + dot(p, y, rank)).alias("z1"), dot(p, q, rank).alias("z2")
    )
    c, more, z0, z1, z2 = F.col("c"), F.col("c") - 1, F.col("z0"), F.col("z1"), F.col("z2")
    terms = [more * z0 * z0 - 2 * c * z0 + c, 2 * more * z0 * z1 - 2 * c * z1, more * (z1 * z1 + 2 * z0 * z2) - 2 * c * z2, 2 * more * z1 * z2, more * z2 * z2]
    parts, zero = met.agg(*(F.sum(t).alias(f"c{i}") for i, t in enumerate(terms))), F.lit(0.0)
    for side in (users, items):
        parts = parts.union(ray_norms(side, rank, ridge).select("xx", 2 * F.col("xp"), "pp", zero, zero))
    row = parts.agg(*(F.sum(f"c{i}") for i in range(5))).first()
    return [w + (v or 0.0) for w, v in zip(whole_ray(users, items, rank), row, strict=True)]
