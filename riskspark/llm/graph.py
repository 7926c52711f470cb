"""Connected components of an edge table by contraction.

Every node hooks onto its smallest neighbour, a few pointer jumps shorten
the resulting trees, and the edges are renamed to what their ends point to;
loops and repeats go.  Each round leaves at most half of the nodes of a
component, and its tables are written to the shared folder, so neither the
lineage nor the driver grows with the graph.  Minima are combined before
the shuffle and the written tables are joined as they are, so a node with
very many edges is a skewed join that adaptive execution may split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.staging import Stage

JUMPS = 2


def components(edges: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node reachable.  Loops, repeats and either direction may occur; rows with
    a null end are dropped."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    e = stage.write(edges.dropna().select(lo.alias("a"), hi.alias("b")).where("a < b").distinct(), f"{name}-e0")
    known, k = None, 0
    while known is None or not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        p = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        p = stage.write(p, f"{name}-h{k}")
        for _ in range(JUMPS):
            p = p.join(p.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p"))
        p = stage.write(p, f"{name}-p{k}")
        pa, pb = (p.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b"))
        renamed = e.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        nxt = stage.write(renamed.where("a < b").distinct(), f"{name}-e{k + 1}")
        if known is None:
            new_known = p.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            new_known = (known.join(p.select(F.col("u").alias("root"), "p"), "root", "left")
                         .select("node", F.coalesce("p", "root").alias("root")))
        new_known = stage.write(new_known, f"{name}-m{k}")
        stage.release(f"{name}-e{k}", f"{name}-h{k}", f"{name}-p{k}", *([f"{name}-m{k - 1}"] if k else []))
        e, known, k = nxt, new_known, k + 1
    return known
