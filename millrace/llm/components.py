"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import delete, saved, side


def _onto(df: DataFrame, column: str, steps: DataFrame) -> DataFrame:
    """df with a column's ids replaced by those that steps(id, to), a saved table, has for them."""
    to = side(steps).select(F.col("id").alias("_id"), F.col("to").alias("_to"))
    return df.join(to, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_to", column)).drop("_id", "_to")


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) to a saved table (id, comp): each linked id with the least id it can reach.

    In each round every id steps to its least neighbour, if that is less; steps are followed to
    their ends, and what they join becomes one id, until no links are left. Each round is written
    to the shared folder. Loops and repeated links don't matter; ids without links get no row.
    """
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"), "edges", n=F.count(F.lit(1)))
    nodes = saved(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "linked")
    comps, spent = nodes.withColumn("comp", F.col("id")), [nodes]
    while edges.told["n"]:
        steps = saved(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")), "steps", sized=True)
        moved = True
        while moved:
            further = _onto(steps.withColumn("was", F.col("to")), "to", steps)
            jumped = saved(further, "steps", sized=True, moved=F.count_if(F.col("was") != F.col("to")))
            delete(steps)
            steps, moved = jumped, jumped.told["moved"]
        comps = _onto(comps, "comp", steps)
        left = _onto(_onto(edges, "a", steps), "b", steps).where("a <> b")
        left = saved(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges", n=F.count(F.lit(1)))
        delete(edges)
        spent.append(steps)
        edges = left
    out = saved(comps, "components", sized=True)
    delete(edges, *spent)
    return out
