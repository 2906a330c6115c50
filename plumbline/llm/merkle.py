"""Merkle manifest of a table: one digest for the whole, one for each group, and for each row a proof of its membership.

Rows are leaves, in order within their group. Every ``FANOUT`` consecutive nodes become one parent until one node is left, the subroot of the group; the
subroots, in the order of the groups, become the root in the same way.

Slot pivot: a level is one grouped aggregate whose conditional aggregates spread the children of a parent into ``FANOUT`` columns. The concatenated columns
hash to the parent; without the own slot they are the siblings of a child. A group of that aggregate holds ``FANOUT`` rows at most, whatever the size of a
source, and a level has a ``FANOUT``-th of the rows of the one below. Places in order come from a range partitioning and the counts of its parts.

Nulls are values of their own (``-``) and sort first. Rows with equal keys are ordered by their digest; equal rows are leaves of their own, each with its own proof. A table
without rows gives no rows. Columns that are not named take no part, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import store

FANOUT = 16


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value: no two lists of values have one encoding."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def in_order(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``g``, a number that ascends with the group, ``pos``, the place in the group from 0, and ``n``, the rows of the group. No task sees a whole group: rows are
    dealt by ranges of group and order, and only counts by range and group are added up."""
    keys = [*group, *order]
    dealt = store.keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("_part", F.shiftright("_row", 33))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = dealt.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    heads = heads.select(*(F.col(c).alias(f"_of_{c}") for c in group), F.col("_part").alias("_in"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"), F.min("_first").over(whole).alias("g"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group], F.col("_part") == F.col("_in"))
    return dealt.join(heads, same).select(*rows.columns, "g", (F.col("_row") - F.col("_first") + F.col("_before")).alias("pos"), "n")


def _pivot(nodes: DataFrame) -> DataFrame:
    """``g, parent, n, c0, c1, ...``: the children of each parent in the columns of their slots, null where there is none. ``nodes``: ``g, pos, n, node``."""
    slot = F.pmod("pos", F.lit(FANOUT))
    return nodes.groupBy("g", F.floor(F.col("pos") / FANOUT).alias("parent"), "n").agg(*(F.first(F.when(slot == k, F.col("node")), ignorenulls=True).alias(f"c{k}") for k in range(FANOUT)))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The pivoted levels, lowest first, and for each level the groups that end there: ``g, digest``. ``nodes``: ``g, pos, n, node``, a struct that has ``digest``."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    wide, tops = [], [nodes.where("n = 1").select("g", "node.digest")]
    while most > 1:
        wide.append(store.keep(_pivot(nodes.where("n > 1")), "level"))
        digest = F.sha2(F.concat_ws("", *(f"c{k}.digest" for k in range(FANOUT))), 256)
        nodes = wide[-1].select("g", F.col("parent").alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"), F.struct(digest.alias("digest")).alias("node"))
        tops.append(nodes.where("n = 1").select("g", "node.digest"))
        most = -(-most // FANOUT)
    return wide, tops


def descend(wide: list[DataFrame], tops: list[DataFrame]) -> DataFrame:
    """``g, pos, node, path`` and the further columns of ``tops`` for each node of the lowest level that has a parent. ``path`` lists what stands left and right of the node and of each
    of its ancestors, upwards. ``tops``: ``g, path, ...`` of the groups that end at a level."""
    above, more = None, [c for c in tops[0].columns if c not in ("g", "path")]
    for k in reversed(range(len(wide))):
        ending = tops[k + 1].select("g", F.lit(0).cast("long").alias("parent"), "path", *more)
        above = ending if above is None else above.select("g", F.col("pos").alias("parent"), "path", *more).unionByName(ending)
        kids = F.array(*(F.col(f"c{j}.digest") for j in range(FANOUT)))
        slots = F.array(*(f"c{j}" for j in range(FANOUT)))
        each = wide[k].join(above, ["g", "parent"]).select("g", "parent", "path", *more, kids.alias("kids"), F.posexplode(slots).alias("slot", "node")).where("node is not null")
        step = F.struct(F.concat_ws("", F.slice("kids", F.lit(1), F.col("slot"))).alias("left"), F.concat_ws("", F.slice("kids", F.col("slot") + 2, F.lit(FANOUT))).alias("right"))
        above = each.select("g", (F.col("parent") * FANOUT + F.col("slot")).alias("pos"), "node", F.concat(F.array(step), "path").alias("path"), *more)
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(rows: DataFrame, leaf: Column, group: str, order: str, carry: dict[str, Column]) -> DataFrame:
    """``leaf, subroot, root, path`` of each row, and the columns ``carry``. Rows are read once; from then on digests and ``carry`` alone are moved."""
    col = F.col(f"`{group}`")
    thin = rows.select(col.alias("source"), F.col(f"`{order}`").alias("place"), leaf.alias("digest"), F.struct(*(v.alias(k) for k, v in carry.items())).alias("carried"))
    placed = in_order(store.keep(thin, "leaves"), ["source"], ["place", "digest"])
    leaves = store.keep(placed.select("g", "pos", "n", F.struct("digest", "carried").alias("node")), "leaves")
    wide, tops = climb(leaves)
    ends = reduce(DataFrame.unionByName, [t.withColumn("level", F.lit(k)) for k, t in enumerate(tops)])
    groups = store.keep(in_order(ends.withColumn("all", F.lit(0)).withColumnRenamed("g", "of"), ["all"], ["of"]), "groups")
    upper, upper_tops = climb(groups.select("g", "pos", "n", F.struct("digest", "of", "level").alias("node")))
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    roots = [t.select("g", nothing.alias("path"), F.col("digest").alias("root")) for t in upper_tops]
    lone = groups.where("n = 1").select("of", "level", "digest", nothing.alias("path"), F.col("digest").alias("root"))
    below = descend(upper, roots)
    subroots = lone if below is None else below.select("node.of", "node.level", "node.digest", "path", "root").unionByName(lone)
    subroots = store.keep(subroots.select(F.col("of").alias("g"), "level", "path", F.col("digest").alias("subroot"), "root"), "subroots")
    found = descend(wide, [subroots.where(F.col("level") == k).drop("level") for k in range(len(tops))])
    single = leaves.where("n = 1").join(subroots.drop("level"), "g").select("node", "path", "subroot", "root")
    whole = single if found is None else found.select("node", "path", "subroot", "root").unionByName(single)
    return whole.select(F.col("node.digest").alias("leaf"), "subroot", "root", "path", "node.carried.*")


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
