"""Training from the command line: ``python -m factorloom.cli --ratings FILE [options]``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.trainers import TRAINERS
from factorloom.sources.ratings import read_text, user_cutoff


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factorloom")
    p.add_argument("--als", action="store_true", help="alternating least squares (wins over --ncg)")
    p.add_argument("--ncg", action="store_true", help="plain conjugate gradient; neither: the preconditioned one")
    p.add_argument("--ratings", "-R", required=True)
    p.add_argument("--delim", "-d", default=",", help="a regular expression")
    p.add_argument("--userBlocks", "-N", type=int, default=10)
    p.add_argument("--itemBlocks", "-M", type=int, default=10)
    p.add_argument("--rank", "-f", type=int, default=10)
    p.add_argument("--maxit", "-k", type=int, default=20)
    p.add_argument("--lambda", "-L", dest="ridge", type=float, default=0.01)
    p.add_argument("--seed", "-s", type=int, default=0)
    p.add_argument("--users", "-n", type=int, help="only users with an id up to this")
    p.add_argument("--items", "-m", type=int, help="only items with an id up to this")
    p.add_argument("--sample", "-S", type=float, help="share of the ratings, chosen by a hash of user and item")
    p.add_argument("--checkpoint", "-C", help="folder for checkpoints, shared by the cluster")
    p.add_argument("--progress", help="folder in which the training is kept, and from which it goes on")
    p.add_argument("--interval", type=int, default=1, help="iterations between two such states")
    p.add_argument("--implicitAlpha", "-a", type=float, help="implicit ratings with this confidence")
    p.add_argument("--output", "-o", help="folder for the model")
    p.add_argument("--saveRatings", help="folder for the ratings that were used, as Parquet")
    p.add_argument("--hist", "-H", help="folder for the history, as CSV")
    p.add_argument("--CDF", "-c", help="folder for the distribution of absolute errors, as CSV")
    p.add_argument("--obj", "-O", type=float, help="say whether the final loss is at most this")
    p.add_argument("--tol", "-t", type=float, help="say whether the final gradient norm is at most this")
    return p


def ratings_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    ratings = read_text(spark, args.ratings, args.delim, args.userBlocks)
    if args.users is not None:
        ratings = user_cutoff(ratings, args.users)
    if args.items is not None:
        ratings = ratings.filter(F.col("item") <= args.items)
    if args.sample is not None:
        ratings = ratings.filter(F.pmod(F.xxhash64("user", "item", F.lit(args.seed)), F.lit(1 << 30)) < int(args.sample * (1 << 30)))
    return ratings


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args, unknown = parser().parse_known_args(argv)
    logging.basicConfig(level=logging.INFO)
    log = logging.getLogger("factorloom")
    for flag in unknown:
        log.warning("skipped: %s", flag)
    spark = spark or SparkSession.builder.appName("factorloom").getOrCreate()
    if args.checkpoint:
        spark.sparkContext.setCheckpointDir(args.checkpoint)
    ratings = ratings_of(spark, args).persist()
    log.info("%s ratings", ratings.count())
    if args.saveRatings:
        ratings.write.mode("overwrite").parquet(args.saveRatings)
    implicit = {"implicit": True, "alpha": args.implicitAlpha} if args.implicitAlpha is not None else {}
    name = "als" if args.als else "ncg" if args.ncg else "pncg"
    model = TRAINERS[name](ratings, rank=args.rank, iterations=args.maxit, ridge=args.ridge, seed=args.seed, user_blocks=args.userBlocks, item_blocks=args.itemBlocks, progress=args.progress, interval=args.interval, **implicit)
    last = model.history.orderBy(F.desc("iter")).first()
    for limit, column in ((args.obj, "loss"), (args.tol, "grad_norm")):
        if limit is not None and last[column] is not None:
            log.info("%s %s: %s", column, last[column], "reached" if last[column] <= limit else "not reached")
    if args.hist:
        model.history.coalesce(1).write.mode("overwrite").option("header", True).csv(args.hist)
    if args.CDF:
        off = model.predict(ratings).select(F.abs(F.col("prediction") - F.col("rating")).alias("off"))
        shares = [i / 100 for i in range(101)]
        rows = off.agg(F.percentile_approx("off", shares, 10000).alias("e")).select(F.posexplode("e").alias("percent", "error"))
        rows.write.mode("overwrite").option("header", True).csv(args.CDF)
    if args.output:
        model.save(args.output)
    return model


if __name__ == "__main__":
    main()
