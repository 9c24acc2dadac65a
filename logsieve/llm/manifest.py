"""Merkle manifest of a dataset: digests of rows, a tree per group over its rows and one tree over the groups' roots.

Rows get their place in a group by one sort over all rows, so a group of any size is dealt over all tasks. Every level is a table
of nodes (tree, place, digest). A node finds the others of its run by equijoins with the computed places of its siblings; the
nodes of slot zero emit the parents. The way back is one equijoin a level from nodes to their parents, which hands the
steps of a proof down: the tables of the levels shrink by the arity, so both ways cost as much as a few joins of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.store import written

STEPS = "array<struct<before: string, after: string>>"


def row_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of all fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""

    def coded(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(coded(f) for f in fields)), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives with the siblings of its steps."""
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with tree and idx, one row per group: group, tree, n): places from 0 of rows in their group and of groups, nulls first.

    One range partitioned sort by group and order. What a partition holds of a group is one row, whose running sums give the
    place of its first; the rows find it by partition and group, so no key has more rows than a partition.
    """
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "sorted")
    runs = placed.groupBy("part", group).agg(F.min("at").alias("from"), F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumns({"offset": F.coalesce(F.sum("here").over(earlier), F.lit(0)), "n": F.sum("here").over(whole)}), "runs")
    firsts = runs.where(F.col("offset") == 0).select("part", "from", F.col(group).alias("of_group"), "n")
    # one row per partition, so the window without keys is as long as there are partitions
    per_part = firsts.groupBy("part").agg(F.count(F.lit(1)).alias("groups"))
    base = per_part.select("part", (F.sum("groups").over(Window.orderBy("part")) - F.col("groups")).alias("base"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("from")) - 1
    named = firsts.withColumn("number", number).join(base, "part").select("of_group", "n", (F.col("base") + F.col("number")).alias("tree"))
    named = written(named, "groups")
    runs = runs.drop("n").join(named, F.col(group).eqNullSafe(F.col("of_group")))
    runs = written(runs.select(F.col("part").alias("of_part"), "of_group", "from", "offset", "tree", "n"), "places")
    found = placed.join(runs, (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of_group")))
    out = found.select(*(f"`{c}`" for c in rows.columns), "tree", "n", (F.col("at") - F.col("from") + F.col("offset")).alias("idx"))
    return out, named.withColumnRenamed("of_group", group)


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, idx, digest, ...) with before and after: the digests of the others of their run, left and right.

    For arity two the sibling's place is the own one XOR 1, else the slots turn by 1 to arity - 1 within the run; each is one
    equijoin on (tree, place). A sibling beyond the last node is the empty string.
    """
    own = nodes
    slot = F.col("idx") % arity
    other = nodes.select(F.col("tree").alias("of_tree"), F.col("idx").alias("of_idx"), F.col("digest").alias("sibling"))
    for shift in range(1, arity):
        place = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (F.col("idx") + shift) % arity
        own = own.withColumn("place", place)
        own = own.join(other, (F.col("tree") == F.col("of_tree")) & (F.col("place") == F.col("of_idx")), "left")
        own = own.withColumn(f"sibling_{shift}", F.coalesce("sibling", F.lit(""))).drop("of_tree", "of_idx", "sibling", "place")
    # slot s has the slots s + 1 .. arity - 1 by the shifts 1 .. arity - 1 - s, then 0 .. s - 1 by the rest
    named = [F.col(f"sibling_{k}") for k in range(1, arity)]
    before = F.concat(F.lit(""), *(F.when(slot + k >= arity, c).otherwise(F.lit("")) for k, c in enumerate(named, 1)))
    after = F.concat(F.lit(""), *(F.when(slot + k < arity, c).otherwise(F.lit("")) for k, c in enumerate(named, 1)))
    return own.withColumns({"before": before, "after": after}).drop(*(f"sibling_{k}" for k in range(1, arity)))


@dataclass
class Forest:
    """The levels of one or many trees: (tree, idx, n, digest, before, after, ...), and the roots (tree, digest)."""

    arity: int
    levels: list[DataFrame]
    roots: DataFrame

    def proved(self, above: DataFrame) -> DataFrame:
        """The lowest level with root and steps. above: (tree, root, steps), what each root hands down."""
        handed = above.withColumnRenamed("tree", "of_tree")
        parents = None
        for height in range(len(self.levels) - 1, -1, -1):
            nodes = self.levels[height]
            # a tree has its root in one level only, so no key comes twice
            found = nodes.where("n = 1").join(handed, F.col("tree") == F.col("of_tree")).drop("of_tree")
            if parents is not None:
                up = parents.toDF("of_tree", "of_idx", "root", "rest")
                low = nodes.where("n > 1").join(up, (F.col("tree") == F.col("of_tree")) & (F.expr(f"idx div {self.arity}") == F.col("of_idx")))
                own = F.array(F.struct("before", "after"))
                found = found.unionByName(low.withColumn("steps", F.concat(own, "rest").cast(STEPS)).drop("of_tree", "of_idx", "rest"))
            if height:
                parents = written(found.select("tree", "idx", "root", "steps"), f"steps-{height}")
        return found


def grow(leaves: DataFrame, arity: int) -> Forest:
    """Levels from leaves (tree, idx, n, digest, ...) up to one node a tree; `n` is the number of the tree's nodes in the level."""
    nodes = written(leaves, "leaves")
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while most > 1:
        level = written(with_siblings(nodes, arity), f"level-{len(levels)}")
        levels.append(level)
        first = level.where((F.col("idx") % arity == 0) & (F.col("n") > 1))
        parent = F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n")
        nodes = first.select("tree", *parent, F.sha2(F.concat("digest", "after"), 256).alias("digest"))
        most = -(-most // arity)
    levels.append(nodes.withColumns({"before": F.lit(""), "after": F.lit("")}))
    roots = [level.where("n = 1").select("tree", "digest") for level in levels]
    return Forest(arity, levels, written(reduce(DataFrame.unionByName, roots), "roots"))


def manifest(
    docs: DataFrame, fields: Sequence[str], group_col: str = "source", order_col: str = "doc_id", arity: int = 3, carry: Sequence[Column] = (),
) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, steps and the carried expressions as carried_0, carried_1, ...

    leaf: `row_digest` of the fields. Per group the leaves ascend by the order column (nulls first; rows of equal order by digest,
    so repeated rows are leaves of their own); while many nodes remain, each run of `arity` becomes the digest of its
    digests, the last run of whatever is left, even of one. What remains is the subroot; the subroots, null group
    first, then bytewise, give the root likewise. A lone leaf is its subroot, a lone subroot the root. steps: an array of
    (before, after), the digests of the siblings on either side, from the leaf's run to the root; `fold` recomputes the root
    from them and `proof_digest` sums them up. Null fields count as such, empty texts as values of no bytes. Further columns of docs,
    whatever their names, are ignored; an empty table gives no rows.
    """
    kept = [c.alias(f"carried_{i}") for i, c in enumerate(carry)]
    digest = row_digest([F.col(f"`{f}`") for f in fields]).alias("digest")
    rows = docs.select(F.col(f"`{order_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("name"), digest, *kept)
    names = [f"carried_{i}" for i in range(len(kept))]
    placed, groups = ranked(written(rows, "digests"), "name", ["id", "digest", *names])
    trees = grow(placed.drop("name"), arity)
    top = grow(trees.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(groups.count()).cast("long").alias("n"), "digest"), arity)
    above = top.roots.select("tree", F.col("digest").alias("root"), F.array().cast(STEPS).alias("steps"))
    above = written(top.proved(above).select(F.col("idx").alias("tree"), F.col("digest").alias("root"), "steps"), "subroots")
    root = top.roots.first()  # one row
    return trees.proved(above).select(
        "id", F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.lit(root["digest"] if root else None).cast("string").alias("root"), "steps", *names
    )
