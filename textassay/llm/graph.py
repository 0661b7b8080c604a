"""Connected components of an edge table, without moving edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges``.

    Each round hooks every node onto its smallest neighbour, follows the hooks one
    step further and contracts the edges to the nodes hooked to, so the edge table
    shrinks fast and the number of rounds grows with the logarithm of a component's
    size, not with its diameter. Only a row count per round reaches the driver.
    """
    live = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = live.select(F.inline(F.array(F.struct("a", "b"), turned)))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = cut(hook.join(above, "up").select("node", F.col("top").alias("up")))
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        live = live.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        live = cut(live.where("a <> b").distinct())
    if not hooks:
        return live.select(F.col("a").alias("node"), F.col("a").alias("root"))
    out = hooks[0].select("node", F.col("up").alias("root"))
    for hook in hooks[1:]:
        nxt = hook.select(F.col("node").alias("root"), F.col("up").alias("next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut(out)
