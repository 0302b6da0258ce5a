"""Hierarchies by a parent key, of any depth and ragged (JN-9, AGG-10): ancestors by pointer doubling, roll-up over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.shared import written


def hierarchy(nodes: DataFrame, key: str = "id", parent: str = "parent") -> tuple[DataFrame, DataFrame]:
    """(closure, faults): (key, ancestor, depth) of every node and each of its ancestors, and (key, fault) of broken nodes.

    A pointer leads from each node to the ancestor 1, 2, 4, ... steps up; a step joins the pointers with themselves, so
    that a depth of d takes log2(d) joins of one row a node. Where a step loses no pointer, all that are left are on a
    cycle or below one: of a chain that ends, some node would have lost its own. The closure then grows by the same
    pointers, over nodes without such a fault.

    Faults: ``lost parent`` (not there; the node counts as a root), ``cycle`` (on or below one; no ancestors),
    ``repeated key`` (the least parent counts) and ``no key`` (a null key is no node).
    """
    n = nodes.select(F.col(key).alias("id"), F.col(parent).alias("up"))
    one = written(n.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("up")))
    there = one.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    linked = one.join(there, "up", "left").select("id", "up", "n", F.coalesce("there", F.lit(False)).alias("there"))
    steps = [written(linked.filter("there").select("id", "up"))]
    before, now = -1, steps[0].count()
    while now not in (0, before):
        last = steps[-1]
        steps.append(written(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("above")), "up").select("id", F.col("above").alias("up"))))
        before, now = now, steps[-1].count()
    endless = steps[-1].select("id")
    closure = steps[0].join(endless, "id", "left_anti").select("id", F.col("up").alias("ancestor"), F.lit(1).alias("depth"))
    for k in range(1, len(steps)):
        # Ancestors of the node 2**(k - 1) steps up are ancestors, so many steps further.
        half = steps[k - 1].select("id", F.col("up").alias("via"))
        closure = written(closure) if k > 1 else closure
        further = half.join(closure.select(F.col("id").alias("via"), "ancestor", "depth"), "via").select("id", "ancestor", (F.col("depth") + (1 << (k - 1))).alias("depth"))
        closure = closure.unionByName(further)
    fault = lambda df, name: df.select(F.col("id").alias(key), F.lit(name).alias("fault"))
    faults = fault(linked.filter("up is not null and not there"), "lost parent").unionByName(fault(endless, "cycle")).unionByName(fault(one.filter("n > 1"), "repeated key")).unionByName(fault(n.filter("id is null"), "no key"))
    return closure.withColumnRenamed("id", key), faults


def rolled_up_tree(values: DataFrame, closure: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """AGG-10: (key, total, n) of each node that has values itself or below it: its own and those of all its descendants."""
    own = values.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    up = own.join(closure, key).select(F.col("ancestor").alias(key), "total", "n")
    return own.unionByName(up).groupBy(key).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
