"""Connected components by repeated contraction.

In each round every node takes the name of the neighbour (or itself) whose hash is
smallest, and links between nodes of one name disappear. Hashes make the order
random, so a chain shrinks by a constant factor a round whatever its ids are. A
node with very many links costs partial aggregates and joins that can be split. The
joins are sort-merge joins, for a loop's many small broadcasts stay with the driver;
where there are few links, a round's tables are one partition each and nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import cut, drop, few, release


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b); a component is named by its smallest node.

    The result is a written table; the rounds' own tables are dropped as they are used up.
    """
    pairs = links.select("a", "b").filter("a <> b")
    edges = cut(pairs.union(pairs.select("b", "a")).distinct().toDF("u", "v"))
    rows = edges.count()
    # no table below has more rows than the first edges: one task for each 65,536 is enough to write it
    spread = lambda df, *spent: cut(df.coalesce(max(1, rows >> 16)), *spent)
    write = lambda df, *spent: few(spread(df, *spent), rows)
    edges = few(edges, rows)
    names = write(edges.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("root")))
    while edges.count():
        release(links.sparkSession)
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        parents = write(edges.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least(F.col("m"), order("u"))["id"].alias("to")))
        names = write(names.join(parents.toDF("root", "to").hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), names)
        moved = few(edges.join(parents.toDF("u", "pu").hint("merge"), "u"), rows).join(parents.toDF("v", "pv").hint("merge"), "v")
        edges = write(moved.filter("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), edges, parents)
    # written, so that the join deals both sides anew and can split a component of very many nodes
    least = write(names.groupBy("root").agg(F.min("node").alias("component")))
    out = spread(names.join(least.hint("merge"), "root").select("node", "component"), names, least)
    drop(edges)
    return out
