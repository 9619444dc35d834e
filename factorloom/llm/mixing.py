"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times it is taken. Among all rates
of at most ``most`` whose words add up to a source's target, the ones closest to
1 in relative entropy are exponentially tilted: ``min(most, exp(lambda * size /
mean size))`` with one multiplier for each source. The multipliers solve a convex
dual, one equation per source, by Newton steps kept inside a bracket; each step
is one aggregation over the table of (source, size, documents). Rates are then
rounded into copies in order of size, by the steps of their running sum, which
misses a source's target by one document at most; of several starting points of
the sum the one that comes nearest is taken. Within documents of one source and
size a hash of the row chooses which get the extra copy.

Only DataFrame operations run here. A hot source shrinks to its distinct sizes
before anything is ordered; a hot (source, size) is split by hash buckets.
Everything that is summed over documents is summed exactly, so reruns agree.

Defined cases: a null text has size 0; documents of size 0 are taken no words of
(their copies are 1); the null source is a source of its own, the last; repeated
rows are separate documents; other columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import by_merge, cut, few, release, small_batches
from factorloom.operators.numbering import ordinals

UNIT = 24  # rates are held as multiples of 2**-24: sums of 2**38 documents of a source fit into 64 bits


def word_count(text: Column) -> Column:
    """Runs of anything but 0x20 and 0x09-0x0D: each becomes one letter, the rest goes."""
    marked = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to rows (source, source_size): weights by code point order, stopping at ``most`` sizes.

    What a stopped source leaves is shared by weight among the others until none is above.
    """
    numbered = ordinals(sources, "source", "__n")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__n") % len(weights) + 1).cast("int"))
    rows = cut(numbered.withColumn("weight", weight).drop("__n"))
    rows = few(rows, rows.count())
    wanted = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    stop, level = most * F.col("source_size"), 0.0
    while True:
        stopped = stop <= level * F.col("weight")
        left, used = rows.agg(F.sum(F.when(~stopped, F.col("weight"))), F.sum(F.when(stopped, stop))).first()
        now = (wanted - (used or 0.0)) / left if left else level
        if now <= level:
            break
        level = now
    return rows.withColumn("target", F.least(stop, level * F.col("weight")))


def multipliers(groups: DataFrame, sources: DataFrame, most: float = 2.0, steps: int = 60, close: float = 1e-7, rows: int | None = None) -> DataFrame:
    """Adds ``lambda`` to the sources: Newton's method on the dual, all sources at once.

    groups: (__key, __size, n) with sizes over 0; sources: (__key, source_size, docs, least, target), each with a group.
    rows: how many groups there are, if that is known; few are read as one partition, so that a step has no exchange.
    """
    rows = groups.count() if rows is None else rows
    x = F.col("__size") / F.col("scale")
    grown = F.col("target") >= F.col("source_size")
    least_x = F.col("least") / F.col("scale")
    state = cut(
        sources.withColumn("scale", F.col("source_size") / F.col("docs")).select(
            "*",
            F.lit(0.0).alias("lambda"),
            F.when(grown, 0.0).otherwise(F.log(F.col("target") / F.col("source_size")) / least_x).alias("low"),
            F.when(grown, math.log(most) / least_x).otherwise(0.0).alias("high"),
        )
    )
    state = few(state, rows)
    kept = state.columns
    tilt = F.col("lambda") * x
    words = F.col("n") * F.col("__size")
    exact = lambda c: F.sum(F.round(c * (1 << 24)).cast("decimal(38,0)")).cast("double") / (1 << 24)
    for done in range(steps):
        if done % 4 == 0:
            release(groups.sparkSession)
        sums = groups.join(by_merge(state.select(*kept), rows), "__key").groupBy(*kept).agg(
            exact(words * F.least(F.lit(most), F.exp(F.least(tilt, F.lit(1.0))))).alias("f"),
            exact(F.when(tilt < math.log(most), words * x * F.exp(tilt)).otherwise(0.0)).alias("slope"),
        )
        off = F.col("f") - F.col("target")
        moved = sums.withColumn("low", F.when(off < 0, F.col("lambda")).otherwise(F.col("low"))).withColumn("high", F.when(off > 0, F.col("lambda")).otherwise(F.col("high")))
        newton = F.col("lambda") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(F.abs(off) <= close * F.col("target"), F.col("lambda")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        # a few digits less than a double has, so that the last ones of exp() can't matter
        moved = moved.withColumn("lambda", F.when(F.col("target") >= most * F.col("source_size"), F.col("high")).otherwise(step)).withColumn("off", F.when(F.col("target") >= most * F.col("source_size"), 0.0).otherwise(F.abs(off) / F.col("target")))
        state = few(cut(moved.select(*kept, "off"), state), rows)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= close:
            break
    return state.select(*kept).withColumn("lambda", F.round("lambda", 12))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, starts: int = 16, names: tuple[str, str, str, str] = ("size", "source_size", "target", "copies"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """All columns of ``docs``, or those in ``keep``, and size, source_size, target and copies (0 to ``most``).

    The rows are written once with their sizes and hashes, and everything that follows reads of that what it needs.
    starts: starting points that are tried for the running sum of a source's rates.
    names: of the four; a column of ``docs`` of one of these names gives way.
    """
    key = F.concat(F.when(F.col(source_col).isNull(), "n").otherwise("s"), F.coalesce(F.col(source_col), F.lit("")))
    small_batches(docs.sparkSession)
    keep = tuple(docs.columns) if keep is None else keep
    made = {"__key": key, "__size": word_count(F.col(text_col)), "__hash": F.xxhash64(id_col, text_col)}
    sized = cut(docs.select(*(F.col(f"`{c}`") for c in keep), *(c.alias(n) for n, c in made.items())))
    groups = cut(sized.groupBy("__key", "__size").agg(F.count("*").alias("n")))
    rows = groups.count()
    groups = few(groups, rows)
    totals = groups.groupBy("__key").agg(F.sum(F.col("n") * F.col("__size")).alias("source_size"), F.sum(F.when(F.col("__size") > 0, F.col("n"))).alias("docs"), F.min(F.when(F.col("__size") > 0, F.col("__size"))).alias("least"))
    totals = totals.withColumn("source", F.when(F.substring("__key", 1, 1) == "s", F.expr("substring(__key, 2)")))
    aims = few(cut(targets(totals, weights, share, most)), rows)
    solved = multipliers(groups.filter("__size > 0"), aims.filter("source_size > 0").drop("source", "weight"), most, rows=rows)
    release(docs.sparkSession)

    # copies of a (source, size): the whole numbers that the running sum of its rates passes
    one = 1 << UNIT
    rate = F.least(F.lit(most * one).cast("long"), F.round(F.exp(F.least(F.col("lambda") * F.col("__size") / F.col("scale"), F.lit(math.log(most)))) * one).cast("long"))
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(most * one).cast("long")).otherwise(rate)
    upto = F.sum("units").over(Window.partitionBy("__key").orderBy("__size").rowsBetween(Window.unboundedPreceding, 0))
    rated = groups.join(by_merge(solved.select("__key", "lambda", "scale", "target", "source_size"), rows), "__key").withColumn("units", F.col("n") * rate).withColumn("upto", upto)
    rated = few(cut(rated.select("__key", "__size", "target", "units", "upto")), rows)
    passed = lambda c: F.shiftright(c + F.col("start"), UNIT)
    whole = passed(F.col("upto")) - passed(F.col("upto") - F.col("units"))
    tried = rated.withColumn("start", F.explode(F.array(*(F.lit((2 * i + 1) * one // (2 * starts)).cast("long") for i in range(starts)))))
    tried = tried.groupBy("__key", "start").agg(F.abs(F.sum(whole * F.col("__size")) - F.first("target")).alias("off"))
    best = tried.groupBy("__key").agg(F.min(F.struct("off", "start")).alias("best")).select("__key", F.col("best.start").alias("start"))
    rated = few(rated.join(by_merge(best, rows), "__key"), rows).withColumn("whole", whole)
    rated = groups.join(by_merge(rated.select("__key", "__size", "whole"), rows), ["__key", "__size"], "left").join(by_merge(aims.select("__key", "source_size", "target"), rows), "__key")
    whole = F.when(F.col("__size") > 0, F.col("whole")).otherwise(F.col("n"))
    of = F.col("n")
    rated = rated.select("__key", "__size", of.alias("__n"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.floor(whole / of).alias("__base"), (whole % of).alias("__extra"))
    rated = cut(rated)
    release(docs.sparkSession)

    # the extra copies of a (source, size) are dealt to hash slots of about 64 rows, then to the first rows of a slot
    placed = sized.join(rated, ["__key", "__size"]).withColumn("__slot", F.pmod(F.col("__hash"), F.ceil(F.col("__n") / 64)))
    # dealt by slot: else the rows of a hot (source, size) would stay together as the join has put them
    placed = placed.repartition("__key", "__size", "__slot")
    slots = placed.groupBy("__key", "__size", "__slot").agg(F.count("*").alias("c"), F.first("__n").alias("n"), F.first("__extra").alias("extra"))
    seen = F.sum("c").over(Window.partitionBy("__key", "__size").orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0))
    slots = slots.withColumn("seen", seen).select("__key", "__size", "__slot", (F.floor(F.col("extra") * F.col("seen") / F.col("n")) - F.floor(F.col("extra") * (F.col("seen") - F.col("c")) / F.col("n"))).alias("__gets"))
    place = F.row_number().over(Window.partitionBy("__key", "__size", "__slot").orderBy("__hash", F.col(f"`{id_col}`")))
    done = placed.join(slots, ["__key", "__size", "__slot"]).withColumn("__place", place)
    copies = (F.col("__base") + F.when(F.col("__place") <= F.col("__gets"), 1).otherwise(0)).cast("long")
    made = F.col("__size"), F.col("__source_size"), F.col("__target"), copies
    return done.select(*(F.col(f"`{c}`") for c in keep if c not in names), *(c.alias(n) for c, n in zip(made, names, strict=True)))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of each row."""
    return mix(docs.select("doc_id", "source", "text"), keep=("doc_id",)).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"))
