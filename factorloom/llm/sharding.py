"""Shards by jump consistent hashing: a stable key and the number of shards decide, no table of a ring is kept.

A key jumps from shard to shard by draws of its own generator; the last shard it
reaches below the number of shards is its shard. With one shard more, a key either
jumps into the new one or stays, so appended shards only receive. The generator is
the 64-bit linear congruential one of the published algorithm, seeded with the first
60 bits of the key's SHA-256, so numbers in a row and any other type are keys alike.

Rows get gapless slots in their shard, in order of key, digest and size: they are
dealt by range of (shard, key, ..), each range is numbered by itself, and the counts
of ranges, a row for each, say where a range begins. Rows that agree in all of that
are told apart by where they were read, so a key with a third of all rows is split;
the rows of such a key still share a shard, as the law wants.

Only DataFrame operations run here. Defined cases: a null text has no bytes (crc32 0);
null keys are one key of their own; repeated rows are rows of their own, with slots of
their own; very long texts are read once, for their bytes and checksum; an empty
table gives an empty table; other columns stay (or those in ``keep``), and those
with the names of the results give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import cut, small_batches

# The multiplier of the published algorithm's generator.
MULTIPLIER = 2862933555777941757


def seed(key: Column) -> Column:
    """The generator's first state: 60 bits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def _jumps(state: str, shards: int, steps: int) -> str:
    """SQL for ``steps`` jumps of a state (b: the shard reached, j: the next, k: the generator's), fewer once j is past the end."""
    turned = f"cast((s.k * {MULTIPLIER} + 1) % 18446744073709551616BD as decimal(20,0))"
    ahead = "cast(floor((s.j + 1) * (2147483648D / cast((k div 8589934592BD) + 1 as double))) as bigint)"
    jump = f"transform(array({turned}), k -> named_struct('b', s.j, 'j', {ahead}, 'k', k))[0]"
    return f"aggregate(sequence(1, {steps}), {state}, (s, i) -> if(s.j < {shards}, {jump}, s))"


def jump(df: DataFrame, key: Column, shards: int) -> DataFrame:
    """Adds ``__shard`` and ``__grown``, the shard of the same key among one shard more.

    Nearly all keys end after a few jumps more than the logarithm of ``shards``; what is left may take ``shards`` of them.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    few = 2 * math.ceil(math.log(shards + 1)) + 6
    df = df.withColumn("__k", seed(key))
    df = df.withColumn("__s", F.expr(_jumps("named_struct('b', -1L, 'j', 0L, 'k', __k)", shards, few)))
    df = df.withColumn("__s", F.when(F.col("__s.j") < shards, F.expr(_jumps("__s", shards, shards))).otherwise(F.col("__s")))
    grown = F.when(F.col("__s.j") == shards, shards).otherwise(F.col("__s.b")).cast("int")
    return df.withColumns({"__shard": F.col("__s.b").cast("int"), "__grown": grown}).drop("__k", "__s")


def sharded(docs: DataFrame, shards: int = 40, key_col: str = "doc_id", text_col: str = "text", overhead: int = 16, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``keep``) and size, text_crc32, law, shard, slot and grown_shard.

    size: the text's bytes and ``overhead``; law: always ``key``; grown_shard: with one shard more.
    """
    small_batches(docs.sparkSession)
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in made)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    placed = jump(docs, F.col(f"`{key_col}`"), shards)
    rows = placed.select(
        *(F.col(f"`{c}`") for c in keep), F.col(f"`{key_col}`").alias("__key"), F.col("__shard"), F.col("__grown"),
        (F.octet_length(text).cast("long") + overhead).alias("__size"), F.crc32(text.cast("binary")).alias("__crc"), F.monotonically_increasing_id().alias("__row"),
    )
    order = ("__key", "__crc", "__size", "__row")
    parts = cut(rows.repartitionByRange("__shard", *order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.groupBy("__part", "__shard").count().withColumn("__begin", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("__part", "__shard").orderBy(*order)) - 1
    found = parts.withColumn("__place", place).join(begins, ["__part", "__shard"])
    return found.select(
        *(F.col(f"`{c}`") for c in keep), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("__shard").alias("shard"),
        (F.col("__begin") + F.col("__place")).cast("long").alias("slot"), F.col("__grown").alias("grown_shard"),
    )


def write(rows: DataFrame, path: str, slots: int = 1 << 20) -> None:
    """Writes rows of ``sharded`` as Parquet, a folder for each shard, in files of about ``slots`` slots each."""
    dealt = rows.withColumn("__file", F.floor(F.col("slot") / slots))
    dealt.repartition("shard", "__file").sortWithinPartitions("shard", "slot").drop("__file").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of 40 shards."""
    return sharded(docs.select("doc_id", "text"), keep=("doc_id",))


_BIT = "CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END"


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB: a bit at a time, eight times a byte."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    byte = f"list_reduce(list_prepend(xor(c, o), CAST(range(8) AS BIGINT[])), lambda y, z: {_BIT})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, o: {byte}), CAST(4294967295 AS BIGINT))"


#: DuckDB SQL for ``digests``.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
walk AS (SELECT rid, CAST('0x' || sha256(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM d
         UNION ALL SELECT rid, n, j, CAST(floor((j + 1) * (2147483648e0 / CAST(n // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
         FROM (SELECT *, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS n FROM walk WHERE j < 40)),
placed AS (SELECT d.rid, doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, {crc32_sql("t")} AS text_crc32, CAST(b AS INTEGER) AS shard, CAST(CASE WHEN j = 40 THEN 40 ELSE b END AS INTEGER) AS grown_shard
           FROM d JOIN walk USING (rid) WHERE j >= 40)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed
"""
