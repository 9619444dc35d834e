"""Counts, blocks and indexes of a ratings table.

Spark's own partitioning replaces hand-made blocks; these operators give the same
layout as tables: which block a rating falls into, which blocks need a factor, local
indexes and row pointers of a compressed block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(column: Column | str, blocks: int) -> Column:
    return F.pmod(F.col(column) if isinstance(column, str) else column, F.lit(blocks))


def layout(ratings: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Ratings dealt and sorted by one side."""
    dealt = ratings.repartition(partitions, key) if partitions else ratings.repartition(key)
    return dealt.sortWithinPartitions(key)


def counts(ratings: DataFrame, key: str) -> DataFrame:
    """(id, n): ratings of each entity."""
    return ratings.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))


def dimensions(ratings: DataFrame) -> DataFrame:
    """One row: n_users and n_items."""
    return ratings.agg(F.countDistinct("user").alias("n_users"), F.countDistinct("item").alias("n_items"))


def transposed(ratings: DataFrame) -> DataFrame:
    """(src, dst, rating) with the item as source."""
    return ratings.select(F.col("item").alias("src"), F.col("user").alias("dst"), "rating")


def rating_blocks(ratings: DataFrame, user_blocks: int, item_blocks: int) -> DataFrame:
    """Number and sum of the ratings in each (user block, item block)."""
    return ratings.groupBy(block_of("user", user_blocks).alias("user_block"), block_of("item", item_blocks).alias("item_block")).agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


def out_links(ratings: DataFrame, src: str, dst: str, blocks: int) -> DataFrame:
    """(id, block): the blocks of the other side that need an entity's factor."""
    return ratings.select(F.col(src).alias("id"), block_of(dst, blocks).alias("block")).distinct()


def local_indices(ratings: DataFrame, src: str, dst: str, blocks: int) -> DataFrame:
    """(block, id, local_index): places of a block's distinct other-side ids in their order, from 0.

    A block is one task's work by definition; ``blocks`` is what bounds its size.
    """
    pairs = ratings.select(block_of(src, blocks).alias("block"), F.col(dst).alias("id")).distinct()
    return pairs.withColumn("local_index", (F.dense_rank().over(Window.partitionBy("block").orderBy("id")) - 1).cast("long"))


def pointers(ratings: DataFrame, src: str, blocks: int) -> DataFrame:
    """(block, id, begin, end): where an entity's ratings lie in its compressed block."""
    sizes = counts(ratings, src).withColumn("block", block_of("id", blocks))
    upto = F.sum("n").over(Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("block", "id", (upto - F.col("n")).alias("begin"), upto.alias("end"))


def index_bits(blocks: int) -> int:
    """Low bits that are left for a local index in a 32-bit code when the block number is above them."""
    return min(32 - (blocks - 1).bit_length(), 31)


def encode_index(block: Column, index: Column, blocks: int) -> Column:
    """Block and local index as one number; a number that doesn't fit fails the query."""
    bits = index_bits(blocks)
    fits = (block >= 0) & (block < blocks) & (index >= 0) & (index < (1 << bits))
    return F.when(fits, F.shiftleft(block.cast("long"), bits).bitwiseOR(index.cast("long"))).otherwise(F.raise_error(F.lit("block or index out of range")).cast("long"))


def decode_index(code: Column, blocks: int) -> tuple[Column, Column]:
    bits = index_bits(blocks)
    return F.shiftrightunsigned(code, bits), code.bitwiseAND(F.lit((1 << bits) - 1))
