"""Entity graph as an edge table: building, degrees, pivots, bounded paths, export."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed
from logsieve.operators.correlate import ENTITY_FIELDS, entities, entity_array
from logsieve.operators.stats import with_scalars
from logsieve.session import cut_lineage

GROUP_PATHS = 5_000  # partial paths with equal ends that one task reduces at a time


def event_edges(df: DataFrame, event_id: str, fields: Sequence[str] = ENTITY_FIELDS) -> DataFrame:
    """Edges from events to their entities."""
    return entities(df, [event_id], fields).select(F.col(event_id).cast("string").alias("event"), "entity").distinct()


def entity_edges(df: DataFrame, fields: Sequence[str] = ENTITY_FIELDS) -> DataFrame:
    """Entities named in one event, smaller to larger, weighted by the number of such events.

    An event has at most as many entities as there are entity fields, so its pairs are few.
    """
    names = entity_array(df.columns, fields)
    pairs = F.flatten(
        F.transform(
            names,
            lambda a, i: F.transform(
                F.slice(names, i + 2, F.size(names)), lambda b: F.struct(a.alias("src"), b.alias("dst"))
            ),
        )
    )
    rows = explode_computed(df, [], pairs, "_p")
    return rows.groupBy("_p.src", "_p.dst").agg(F.count(F.lit(1)).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("_e"))
    return ends.groupBy("_e.node").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("_e.o").alias("out_degree"), F.count_if(F.col("_e.o") == 0).alias("in_degree")
    )


def graph_pivots(
    df: DataFrame,
    event_id: str,
    fields: Sequence[str] = ENTITY_FIELDS,
    min_nodes: int = 10,
    centrality: float = 0.1,
    min_degree: int = 5,
    min_events: int = 5,
) -> DataFrame:
    """Entities tied to a large part of the graph of events and entities."""
    linked = event_edges(df, event_id, fields)
    by_entity = linked.groupBy("entity").agg(F.count(F.lit(1)).alias("events"))
    neighbours = degrees(entity_edges(df, fields)).select(F.col("node").alias("entity"), F.col("degree").alias("_others"))
    size = linked.agg(F.count_distinct("event").alias("_e"), F.count_distinct("entity").alias("_n"))
    joined = by_entity.join(neighbours, "entity", "left").withColumn(
        "degree", F.col("events") + F.coalesce("_others", F.lit(0))
    )
    sized = with_scalars(joined, size).withColumn("nodes", F.col("_e") + F.col("_n"))
    score = F.col("degree") / (F.col("nodes") - 1)
    return sized.where(
        (F.col("nodes") >= min_nodes) & (score > centrality) & (F.col("degree") >= min_degree) & (F.col("events") >= min_events)
    ).select("entity", "events", "degree", score.alias("centrality"))


def distances_to_ends(links: DataFrame, most: int) -> DataFrame:
    """(node, dist): edges on the shortest way to a node without outgoing edges, for those within `most`."""
    ends = links.select(F.col("dst").alias("node")).distinct().join(links.select(F.col("src").alias("node")), "node", "left_anti")
    known = frontier = cut_lineage(ends.withColumn("dist", F.lit(0)))
    for dist in range(1, most + 1):
        back = links.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        frontier = cut_lineage(back.join(known.select("node"), "node", "left_anti").withColumn("dist", F.lit(dist)))
        known = known.unionByName(frontier)
    return known


def _needed(inner: frozenset, kept: Sequence[frozenset], per_pair: int, left: int) -> bool:
    """Whether some continuation of up to `left` nodes is open to this path, but to fewer than `per_pair` of those kept."""

    def blocked(nodes: frozenset, left: int) -> bool:
        free = [k for k in kept if not k & nodes][:per_pair]
        if len(free) < per_pair:
            return True
        return left > 0 and any(blocked(nodes | {n}, left - 1) for k in free for n in k - inner)

    return blocked(frozenset(), left)


def _representing(per_pair: int, left: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[sorted(range(len(rows)), key=lambda i: list(rows["path"].iloc[i]))]
        kept, places = [], []
        for place, path in enumerate(rows["path"]):
            inner = frozenset(path[1:-1])
            if _needed(inner, kept, per_pair, left):
                kept.append(inner)
                places.append(place)
        return rows.iloc[places]

    return run


def _representatives(paths: DataFrame, per_pair: int, left: int) -> DataFrame:
    """Of the paths with equal start and last node those that hold the first `per_pair` for every continuation.

    Which paths a continuation is open to depends on its nodes: up to `left`, none of them on the path. A path is dropped only if
    any such nodes leave `per_pair` smaller paths open, so few are kept, whatever the graph: their number is bounded by the length alone.
    Large groups are reduced in parts first, which keeps the same property.
    """
    counted = cut_lineage(paths.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("start", "last"))))
    few, many = counted.where(F.col("_n") <= per_pair).drop("_n"), counted.where(F.col("_n") > per_pair)
    most = counted.agg(F.max("_n")).first()[0] or 0
    if most <= per_pair:
        return few
    schema = few.schema
    if most > GROUP_PATHS:
        part = F.pmod(F.xxhash64("path"), F.ceil(F.col("_n") / GROUP_PATHS)).alias("_part")
        many = many.groupBy("start", "last", part).applyInPandas(_representing(per_pair, left), many.schema)
    reduced = many.drop("_n").groupBy("start", "last").applyInPandas(_representing(per_pair, left), schema)
    return few.unionByName(reduced)


def graph_paths(
    edges: DataFrame, max_edges: int = 5, min_nodes: int = 4, per_pair: int = 3, min_graph_nodes: int = 20
) -> DataFrame:
    """Paths from nodes without incoming to nodes without outgoing edges, the first three per pair of ends.

    No path visits a node twice, in graphs with cycles too. Partial paths go on only where an end is near enough, and of those with
    equal start, last node and length the ones are kept that some continuation needs (`_representatives`), so always the first
    three are found where three exist.
    """
    links = cut_lineage(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    nodes = degrees(links)
    big_enough = nodes.agg((F.count(F.lit(1)) > min_graph_nodes).alias("_big"))
    ahead = distances_to_ends(links, max_edges).select(F.col("node").alias("last"), "dist")
    starts = nodes.where("in_degree = 0").select(F.col("node").alias("start"))
    paths = starts.select("start", F.col("start").alias("last"), F.array("start").alias("path")).join(ahead.where(F.col("dist") <= max_edges).select("last"), "last", "left_semi")
    paths = paths.select("start", "last", "path")
    found = None
    for length in range(1, max_edges + 1):
        grown = paths.join(links, (F.col("last") == F.col("src")) & ~F.array_contains("path", F.col("dst"))).select(
            "start", F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path")
        )
        open_ones = grown.join(ahead.where(F.col("dist") <= max_edges - length).select("last"), "last", "left_semi").select("start", "last", "path")
        paths = cut_lineage(_representatives(open_ones, per_pair, max_edges - length))
        if length + 1 >= min_nodes:
            done = paths.join(ahead.where("dist = 0").select("last"), "last", "left_semi").select("start", "last", "path")
            found = done if found is None else found.union(done)
    order = W.partitionBy("start", "last").orderBy("path")
    ranked = found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_pair)
    return with_scalars(ranked, big_enough).where("_big").drop("_big").withColumnRenamed("last", "end")


def path_events(paths: DataFrame, linked: DataFrame, min_events: int = 3) -> DataFrame:
    """Events that hold both ends of an edge of a path; paths with fewer than three are dropped."""
    steps = paths.select(
        "start", "end", "position",
        F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("step", "_e"),
    ).select("start", "end", "position", F.col("_e.a").alias("a"), F.col("_e.b").alias("b"))
    wanted = steps.select("a", "b").distinct()
    left = wanted.join(linked.select(F.col("entity").alias("a"), "event"), "a")
    both = left.join(linked.select(F.col("entity").alias("b"), "event"), ["b", "event"])
    events = steps.join(both, ["a", "b"]).select("start", "end", "position", "event").distinct()
    counts = events.groupBy("start", "end", "position").agg(F.count(F.lit(1)).alias("events")).where(F.col("events") >= min_events)
    return paths.join(counts, ["start", "end", "position"])


def graph_nodes(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes with degree and centrality; with a limit the best connected ones, in order."""
    nodes = degrees(edges)
    sized = with_scalars(nodes, nodes.agg(F.count(F.lit(1)).alias("_n")))
    out = sized.select("node", "degree", (F.col("degree") / (F.col("_n") - 1)).alias("centrality"))
    return out.orderBy(F.desc("degree"), "node").limit(limit) if limit is not None else out


def graph_edges(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges with their weight; with a limit the heaviest ones, in order."""
    out = edges.select("src", "dst", "weight")
    return out.orderBy(F.desc("weight"), "src", "dst").limit(limit) if limit is not None else out


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and density m / (n (n - 1))."""
    links = edges.select("src", "dst").distinct()
    m = links.agg(F.count(F.lit(1)).alias("edges"))
    n = degrees(links).agg(F.count(F.lit(1)).alias("nodes"))
    sized = with_scalars(m, n)
    return sized.select(
        "nodes", "edges", F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density")
    )
