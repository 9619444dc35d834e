"""The three trainers: alternating least squares, conjugate gradient, and conjugate gradient preconditioned by the first.

Each side's state is one table, so vectors of one entity meet in a row and never in a
join. Ratings stay in their blocks; a pass sends the other side's vectors to them. Only
scalars come to the driver, and they are exact sums, so partitions don't change a bit.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.exact import counted, exact_sums, totals
from factorloom.functions.vectors import dot, lattice, mixed, random_unit, scaled
from factorloom.operators import exchange as X
from factorloom.operators import objective as O
from factorloom.operators.normal_equations import gram, grams
from factorloom.operators.solvers import minimize
from factorloom.plans import progress
from factorloom.plans.lineage import Tables, cut, drop, forget
from factorloom.plans.model import FactorModel

log = logging.getLogger("factorloom")
SIDES = ("user", "item")
HISTORY = "iter int, alpha double, beta double, grad_norm double, loss double"
SAME = ("rank", "ridge", "implicit", "alpha", "nonnegative", "seed", "init", "line_search")


@dataclass
class Settings:
    """What all trainers share.

    user_blocks, item_blocks: into which the ratings are dealt; by default one for each million, or shuffle partitions.
    intermediate_level: of the two layouts of the ratings; final_level: of the factors, NONE leaves them unpersisted.
    progress: a folder in which every ``interval`` iterations the training's state is kept; a training that finds one of the
    same settings there goes on from it. implicit: ratings over 0 are preferences seen with confidence 1 + alpha r, all other
    pairs are preferences of 0 seen with confidence 1.
    """

    rank: int = 10
    iterations: int = 10
    ridge: float = 0.01
    implicit: bool = False
    alpha: float = 1.0
    nonnegative: bool = False
    user_blocks: int | None = None
    item_blocks: int | None = None
    intermediate_level: StorageLevel = field(default_factory=lambda: StorageLevel.MEMORY_AND_DISK)
    final_level: StorageLevel = field(default_factory=lambda: StorageLevel.MEMORY_AND_DISK)
    seed: int = 0
    init: str = "random"
    line_search: str = "exact"
    progress: str | None = None
    interval: int = 1
    part: int = X.PART
    history: list[tuple] = field(default_factory=list)

    def check(self, trainer: str) -> None:
        if self.rank < 1 or self.iterations < 0 or self.ridge < 0:
            raise ValueError("rank must be positive, iterations and ridge not negative")
        if self.line_search not in ("exact", "doubled"):
            raise ValueError("line_search is exact or doubled")
        if self.init not in ("random", "lattice"):
            raise ValueError("init is random or lattice")
        if self.interval < 1 or self.part < 1:
            raise ValueError("interval and part are positive")
        if trainer == "ncg" and self.nonnegative:
            raise NotImplementedError("plain conjugate gradient has no non-negative form")
        if self.intermediate_level == StorageLevel.NONE:
            raise ValueError("the ratings need a storage level")

    def note(self, iteration: int, alpha: float | None, beta: float | None, grad: float | None, loss: float | None) -> None:
        self.history.append((iteration, alpha, beta, grad, loss))
        log.info("iteration %s: alpha %s, beta %s, gradient %s, loss %s", iteration, alpha, beta, grad, loss)


def initial(sizes: DataFrame, s: Settings, side: int) -> DataFrame:
    """(id, n, factor) of the entities that have ratings."""
    vector = lattice(F.col("id"), s.rank, 101 * side) if s.init == "lattice" else random_unit(F.col("id"), s.rank, s.seed, side)
    return sizes.select("id", F.col("seen" if s.implicit else "n").cast("double").alias("n"), vector.alias("factor"))


def other(key: str) -> str:
    return SIDES[key == "user"]


class _Run:
    """Both layouts of the ratings, the sides' states and the loop's helpers."""

    def __init__(self, ratings: DataFrame, s: Settings):
        self.s, spark = s, ratings.sparkSession
        # written until both layouts are made, so that what makes the ratings runs once and its exchanges aren't kept
        ratings = cut(ratings.select("user", "item", "rating"))
        forget(spark)
        sizes = {key: cut(ratings.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("rating") > 0).alias("seen"))) for key in SIDES}
        tally = [F.sum("n"), F.count_if(F.col("n") > s.part)]
        rows, *many = (v or 0 for row in sizes["user"].agg(*tally).union(sizes["item"].agg(*tally)).collect() for v in row)
        usual = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows >> 20)
        self.by = {key: X.deal(ratings, key, sizes[key], n or usual, s.intermediate_level, s.part, many[2 * i]) for i, (key, n) in enumerate(zip(SIDES, (s.user_blocks, s.item_blocks), strict=True))}
        self.by["user"].theirs.union(self.by["item"].theirs).count()
        drop(ratings)
        self.written: dict[str, DataFrame] = {}
        self.state: dict[str, DataFrame] = {key: initial(sizes[key], s, i) for i, key in enumerate(SIDES)}

    def solve(self, key: str, own: DataFrame | None, theirs: DataFrame, by: str = "factor", graded: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """One side solved against the other's vectors ``by``; with ``own`` its gradient and value at its factor too."""
        s = self.s
        whole = gram(theirs, s.rank, by, by) if s.implicit else None
        more = gram(theirs, s.rank, graded, graded) if s.implicit and graded else None
        p = X.solving(s.rank, s.ridge, s.nonnegative, s.implicit, s.alpha, whole, None if own is None else "factor", by, graded, more)
        return X.run(self.by[key], p, theirs, own, keep)

    def grade(self, key: str, own: DataFrame, theirs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        s = self.s
        return X.run(self.by[key], X.grading(s.rank, s.ridge, s.implicit, s.alpha, gram(theirs, s.rank) if s.implicit else None), theirs, own, keep)

    def norm(self) -> Column:
        return F.lit(float(self.s.ridge)) * F.col("n") * dot(F.col("factor"), F.col("factor"), self.s.rank)

    def sums(self, *columns: Column) -> list[float]:
        """Exact sums over the rows of both sides, in one job."""
        named = [c.alias(f"s{n}") for n, c in enumerate(columns)]
        both = self.state["user"].select(*named).union(self.state["item"].select(*named))
        return exact_sums(both, *(F.col(f"s{n}") for n in range(len(columns))))

    def replace(self, **new: DataFrame) -> None:
        """New states, written one after the other; what they were made from is dropped when all are there."""
        spent = [self.written[key] for key in new if key in self.written]
        for key, df in new.items():
            self.written[key] = self.state[key] = cut(df)
            forget(df.sparkSession)
        drop(*spent)

    def line(self, starts: list[float]) -> tuple[float, float]:
        """The lowest point along p from the factors of both sides, and the value there."""
        s, x, p = self.s, F.col("factor"), F.col("p")
        weight = F.lit(float(s.ridge)) * F.col("n")
        norms = [weight * dot(x, x, s.rank), 2.0 * weight * dot(x, p, s.rank), (2.0 if s.line_search == "doubled" else 1.0) * weight * dot(p, p, s.rank)]
        counts = X.scalars(self.by["user"], X.along(s.rank, s.implicit, s.alpha), self.state["item"], self.state["user"])
        for key in SIDES:
            counts = counts.union(counted(self.state[key], norms))
        c = totals(counts, 5)
        forget(counts.sparkSession)
        if s.implicit:
            c = [a + b for a, b in zip(c, O.whole_ray(self.state["user"], self.state["item"], s.rank), strict=True)]
        return minimize(c, starts)

    def tried(self, steps: list[tuple[float, str]]) -> tuple[float, str, float]:
        """Of the steps (t, vector d) the one whose point max(0, factor + t d) is lowest, and the value there, from one pass."""
        s = self.s
        point = lambda t, d: F.zip_with(F.col("factor"), F.col(d), lambda x, y: F.greatest(x + y * t, F.lit(0.0)))
        norms = [F.lit(float(s.ridge)) * F.col("n") * F.aggregate(point(t, d), F.lit(0.0), lambda a, v: a + v * v) for t, d in steps]
        counts = X.scalars(self.by["user"], X.trying(s.rank, steps, s.implicit, s.alpha), self.state["item"], self.state["user"])
        for key in SIDES:
            counts = counts.union(counted(self.state[key], norms))
        values = totals(counts, len(steps))
        forget(counts.sparkSession)
        if s.implicit:
            names = [(f"t{n}", f"t{n}") for n in range(len(steps))]
            sides = [grams(self.state[key].select(*(point(t, d).alias(f"t{n}") for n, (t, d) in enumerate(steps))), s.rank, *names) for key in SIDES]
            values = [v + float((a * b).sum()) for v, a, b in zip(values, *sides, strict=True)]
        value, n = min((v, n) for n, v in enumerate(values))
        return *steps[n], value

    def model(self, tables: Tables) -> FactorModel:
        s = self.s
        tables.keep(*self.written.values())
        out = [self.state[key].select("id", F.col("factor").cast("array<float>").alias("features")) for key in SIDES]
        if s.final_level != StorageLevel.NONE:
            for df in out:
                df.persist(s.final_level).count()
        for blocks in self.by.values():  # the states are written tables and need them no more
            blocks.unpersist()
        spark = out[0].sparkSession
        return FactorModel(s.rank, *out, spark.createDataFrame(s.history, HISTORY), tables)


def _train(name: str, ratings: DataFrame, settings: dict, start: Callable, step: Callable) -> FactorModel:
    """start(run) and step(run, iteration, scalars) give the scalars that the next step needs; None ends the training."""
    s = Settings(**settings)
    s.check(name)
    spark = ratings.sparkSession
    same = {"trainer": name} | {key: getattr(s, key) for key in SAME}
    with Tables() as tables:
        run = _Run(ratings, s)
        found = progress.latest(spark, s.progress, same, s.iterations) if s.progress else None
        if found:
            done, scalars, run.state = found.iteration, found.scalars, found.states
            s.history[:] = found.history
        else:
            done, scalars = 0, start(run)
        for i in range(done + 1, s.iterations + 1):
            scalars = step(run, i, scalars)
            if scalars is None:
                break
            if s.progress and i % s.interval == 0:
                progress.save(spark, s.progress, progress.Progress(i, scalars, run.state, s.history), same)
        return run.model(tables)


def train_als(ratings: DataFrame, **settings) -> FactorModel:
    """Alternating least squares: the items first, then the users from the new items.

    A pass over the ratings by item gives the items' gradient and the next items; the loss is in the users' sums.
    """

    def start(run: _Run) -> dict:
        run.replace(item=run.solve("item", run.state["item"], run.state["user"]))
        value = exact_sums(run.state["user"].select(run.norm().alias("v")).union(run.state["item"].select("was")), F.col("v"))
        run.s.note(0, None, None, None, value[0])
        return {}

    def step(run: _Run, i: int, scalars: dict) -> dict:
        grad = F.col("grad")
        items = run.state["item"].select("id", "n", F.col("solved").alias("factor"))
        run.replace(user=run.solve("user", None, items).select("id", "n", F.col("solved").alias("factor"), "loss"))
        run.replace(item=run.solve("item", items, run.state["user"]))
        # the users' gradient is zero after their own step
        ends = run.state["user"].select(F.col("loss").alias("v"), F.lit(0.0).alias("g")).union(run.state["item"].select(run.norm(), dot(grad, grad, run.s.rank)))
        loss, square = exact_sums(ends, F.col("v"), F.col("g"))
        run.s.note(i, None, None, math.sqrt(square), loss)
        return {}

    return _train("als", ratings, settings, start, step)


def train_ncg(ratings: DataFrame, **settings) -> FactorModel:
    """Nonlinear conjugate gradient (Polak and Ribiere, restarted where beta is negative)."""
    g, p, old = F.col("grad"), F.col("p"), F.col("old")

    def graded(run: _Run, *keep: str) -> None:
        was = dict(run.state)
        run.replace(**{key: run.grade(key, was[key], was[other(key)], keep) for key in SIDES})

    def start(run: _Run) -> dict:
        k = run.s.rank
        graded(run)
        gg, users, norms = run.sums(dot(g, g, k), F.col("error"), run.norm())
        error = users / 2  # each rating is in both sides' sums
        if run.s.implicit:
            error += float((gram(run.state["user"], k) * gram(run.state["item"], k)).sum())
        run.state = {key: df.withColumn("p", scaled(-1.0, g)) for key, df in run.state.items()}
        run.s.note(0, None, None, math.sqrt(gg), error + norms)
        return {"alpha": 1.0, "pp": gg}

    def step(run: _Run, i: int, scalars: dict) -> dict | None:
        k, pp = run.s.rank, scalars["pp"]
        if pp <= 0:
            return None
        # the step is searched along the direction at length 1, the recurrence keeps it as it was
        raw, length = run.state, math.sqrt(pp)
        run.state = {key: df.withColumn("raw", p).withColumn("p", scaled(1 / length, p)) for key, df in raw.items()}
        alpha, loss = run.line([2 * abs(scalars["alpha"]), 500.0])
        run.state = {key: df.select("id", "n", mixed(alpha, p, 1.0, F.col("factor")).alias("factor"), g.alias("old"), F.col("raw").alias("p")) for key, df in run.state.items()}
        graded(run, "old", "p")
        gg, go, oo, gp, dd = run.sums(dot(g, g, k), dot(g, old, k), dot(old, old, k), dot(g, p, k), dot(p, p, k))
        beta = (gg - go) / oo if oo else 0.0
        restart = beta < 0 or alpha == 0
        run.state = {key: df.withColumn("p", scaled(-1.0, g) if restart else mixed(-1.0, g, beta, p)) for key, df in run.state.items()}
        run.s.note(i, alpha, beta, math.sqrt(gg), loss)
        return {"alpha": alpha, "pp": gg if restart else gg - 2 * beta * gp + beta**2 * dd}

    return _train("ncg", ratings, settings, start, step)


def train_pncg(ratings: DataFrame, **settings) -> FactorModel:
    """Conjugate gradient preconditioned by a round of alternating least squares: users, then items from the new users.

    nonnegative: components at 0 that the direction would take below are held, and the step is searched along the path that
    is cut off at 0: around the lowest point of the direction's own quartic, and on the way to the round's result, whose end
    is never higher than the start. So the loss doesn't rise, and no iteration gains less than the round alone.
    """
    x, g, pre, p = (F.col(c) for c in ("factor", "grad", "pre", "p"))

    def advance(run: _Run, *keep: str) -> None:
        """States with the gradient and the preconditioned one, x minus the round's result; two passes over the ratings."""
        step = mixed(1.0, x, -1.0, F.col("solved"))
        was, spent = run.state, run.written
        users = cut(run.solve("user", was["user"], was["item"], keep=keep))
        if spent:
            drop(spent["user"])  # the new states hold what the items' pass needs of it
        forget(users.sparkSession)
        items = cut(run.solve("item", was["item"], users, "solved", "factor", keep))
        forget(users.sparkSession)
        run.written = {"user": users, "item": items}
        run.state = {key: df.withColumn("pre", step).drop("solved", "loss") for key, df in run.written.items()}
        if spent:
            drop(spent["item"])

    def start(run: _Run) -> dict:
        k = run.s.rank
        advance(run)
        gg, gp = run.sums(dot(g, g, k), dot(g, pre, k))
        value = exact_sums(run.state["item"].select(run.norm().alias("v")).union(run.state["user"].select("was")), F.col("v"))
        run.state = {key: df.withColumn("p", scaled(-1.0, pre)) for key, df in run.state.items()}
        run.s.note(0, None, None, math.sqrt(gg), value[0])
        return {"gp": gp}

    def step(run: _Run, i: int, scalars: dict) -> dict | None:
        k, before = run.s.rank, scalars["gp"]
        if before == 0:
            return None
        alpha, loss = run.line([0.0, 2.0])
        if run.s.nonnegative:
            run.state = {key: df.withColumn("back", scaled(-1.0, pre)) for key, df in run.state.items()}
            alpha, along, loss = run.tried([*((alpha * f, "p") for f in (1.0, 0.5, 0.2, 2.0)), (1.0, "back"), (1.5, "back"), (2.0, "back")])
            moved = F.transform(mixed(alpha, F.col(along), 1.0, x), lambda v: F.greatest(v, F.lit(0.0)))
            run.state = {key: df.select("id", "n", moved.alias("factor"), pre.alias("old"), F.col(along).alias("p")) for key, df in run.state.items()}
        else:
            run.state = {key: df.select("id", "n", mixed(alpha, p, 1.0, x).alias("factor"), pre.alias("old"), "p") for key, df in run.state.items()}
        advance(run, "old", "p")
        gg, gp, go = run.sums(dot(g, g, k), dot(g, pre, k), dot(g, F.col("old"), k))
        beta = (gp - go) / before
        restart = beta < 0 or alpha == 0
        new = scaled(-1.0, pre) if restart else mixed(-1.0, pre, beta, p)
        if run.s.nonnegative:
            new = F.zip_with(x, new, lambda a, d: F.when((a <= 0) & (d < 0), 0.0).otherwise(d))
        run.state = {key: df.withColumn("p", new) for key, df in run.state.items()}
        run.s.note(i, alpha, beta, math.sqrt(gg), loss)
        return {"gp": gp}

    return _train("pncg", ratings, settings, start, step)


TRAINERS = {"als": train_als, "ncg": train_ncg, "pncg": train_pncg}
