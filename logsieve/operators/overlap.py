"""Exact set-overlap pairs without pairing up whole groups.

Sets are first reduced to distinct sets: copies of one set, however many, become one
member of the join. Tokens are ranked from rare to frequent and only as many of the
rarest tokens of a set as the threshold can lose, plus one, act as join keys. Any pair
that reaches the threshold shares one of them, so nothing is missed, and a token that a
third of all sets hold is a key only for sets that have hardly anything else. What is
left of two sets from a shared key on, in that order, bounds what they can share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_sets(df: DataFrame, key: str, token: str) -> tuple[DataFrame, DataFrame]:
    """(members: key -> set_id, tokens: set_id -> token, size). A set is named by its smallest key."""
    rows = df.where(F.col(key).isNotNull() & F.col(token).isNotNull()).select(F.col(key).alias("_k"), F.col(token).alias("_t")).distinct()
    # an order-free digest, so that no set has to be gathered to be compared
    low, high = F.xxhash64("_t"), F.xxhash64(F.lit("second"), "_t")
    digest = ["size", "_x", "_y", "_s"]
    named = rows.groupBy("_k").agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(low).alias("_x"),
        F.bit_xor(high).alias("_y"),
        F.sum(F.pmod(low, F.lit(2_147_483_647))).alias("_s"),
    )
    heads = named.groupBy(*digest).agg(F.min("_k").alias("set_id"))
    members = named.join(heads, digest).select(F.col("_k").alias(key), "set_id", "size")
    tokens = rows.join(heads.select("set_id", "size"), F.col("_k") == F.col("set_id")).select("set_id", "size", F.col("_t").alias("token"))
    return members, tokens


def _ranked(tokens: DataFrame) -> DataFrame:
    """Position of each token in its set, rarest first."""
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    order = W.partitionBy("set_id").orderBy("_df", "token")
    return tokens.join(frequency, "token").withColumn("_pos", F.row_number().over(order))


def _shared(candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    """Number of tokens the two sets of each candidate pair share. Only tokens of candidates are moved."""

    def of(side: str) -> DataFrame:
        return tokens.join(candidates.select(F.col(side).alias("set_id")).distinct(), "set_id", "left_semi").select(F.col("set_id").alias(side), "token")

    left = candidates.select("a_set", "b_set").join(of("a_set"), "a_set")
    return (
        left.join(of("b_set"), ["b_set", "token"])
        .groupBy("a_set", "b_set")
        .agg(F.count(F.lit(1)).alias("shared"))
    )


def jaccard_pairs(tokens: DataFrame, over: float, inclusive: bool = False) -> DataFrame:
    """Pairs of distinct sets with Jaccard similarity above `over`."""
    from logsieve.session import cut_lineage

    prefix = _prefix(tokens, over)
    a, b = _sides(prefix)
    candidates = cut_lineage(a.join(b, "token").where((F.col("a_set") < F.col("b_set")) & _possible(over)).select(*PAIR).distinct())
    return _similar(candidates, tokens, over, inclusive)


PAIR = ("a_set", "a_size", "b_set", "b_size")
SLACK = 1e-9  # of products of sizes with a threshold, so that rounding drops no candidate


def _prefix(tokens: DataFrame, over: float) -> DataFrame:
    """(set_id, size, token, _pos): as many of the rarest tokens of a set as a set that similar must hold one of."""
    # similarity t needs t * size shared tokens, so a set may lose (1 - t) * size of them
    keep = F.col("size") - F.ceil(F.col("size") * over - SLACK) + 1
    return _ranked(tokens).where(F.col("_pos") <= keep).select("set_id", "size", "token", "_pos")


def _sides(prefix: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    names = {"set_id": "set", "size": "size", "_pos": "pos", **{c: c for c in more}}
    return tuple(prefix.select("token", *[F.col(c).alias(f"{side}_{n}") for c, n in names.items()]) for side in "ab")


def _possible(over: float) -> Column:
    """Sizes alike, and enough of both sets left from the shared token on; holds at the first token that similar sets share."""
    alike = (F.col("b_size") >= F.col("a_size") * over - SLACK) & (F.col("a_size") >= F.col("b_size") * over - SLACK)
    left = 1 + F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    return alike & (left >= (F.col("a_size") + F.col("b_size")) * (over / (1 + over)) - SLACK)


def _similar(candidates: DataFrame, tokens: DataFrame, over: float, inclusive: bool) -> DataFrame:
    scored = candidates.join(_shared(candidates, tokens), ["a_set", "b_set"]).withColumn(
        "similarity", F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared"))
    )
    return scored.where((F.col("similarity") >= over) if inclusive else (F.col("similarity") > over))


def similar_classes(tokens: DataFrame, over: float, inclusive: bool = False) -> DataFrame:
    """(set_id, class_id) of all sets: the smallest set reachable over pairs with Jaccard similarity above `over`.

    Exact without all pairs. First every set meets one leader of each prefix token it holds; m near copies, which share
    most of their tokens, so make about m candidates a token, not m * m / 2. Then only sets that are still in different
    classes and share a prefix token are compared: a pair within one class could not change the result.
    """
    from logsieve.session import cut_lineage

    prefix = cut_lineage(_prefix(tokens, over))
    # the leader of a token is found with partial aggregation; few sets lead, since the order is the same for all tokens
    a, b = _sides(prefix)
    lead = a.groupBy("token").agg(F.min(F.struct(F.xxhash64("a_set").alias("_h"), "a_set", "a_size", "a_pos")).alias("_l")).select("token", "_l.a_set", "_l.a_size", "_l.a_pos")
    met = lead.join(b, "token").where((F.col("a_set") != F.col("b_set")) & _possible(over))
    swap = F.col("a_set") > F.col("b_set")
    named = [F.when(swap, F.col(f"{y}_{n}")).otherwise(F.col(f"{x}_{n}")).alias(f"{x}_{n}") for x, y in ("ab", "ba") for n in ("set", "size")]
    first = cut_lineage(met.select(*named).distinct())
    links = cut_lineage(_similar(first, tokens, over, inclusive).select(F.col("a_set").alias("u"), F.col("b_set").alias("v")))
    sets = tokens.select("set_id").distinct()

    def classes(edges: DataFrame) -> DataFrame:
        found = connected_components(edges)
        return sets.join(found, F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("component", "set_id").alias("class_id"))

    placed = prefix.join(classes(links), "set_id")
    mixed = placed.groupBy("token").agg(F.min("class_id").alias("_least"), F.max("class_id").alias("_most")).where("_least < _most").select("token")
    a, b = _sides(placed.join(mixed, "token", "left_semi"), "class_id")
    crossing = a.join(b, "token").where((F.col("a_set") < F.col("b_set")) & (F.col("a_class_id") != F.col("b_class_id")) & _possible(over)).select(*PAIR).distinct()
    crossing = cut_lineage(crossing.join(first, ["a_set", "b_set"], "left_anti"))
    more = _similar(crossing, tokens, over, inclusive).select(F.col("a_set").alias("u"), F.col("b_set").alias("v"))
    return classes(links.union(more))


def containment_pairs(tokens: DataFrame, share: float) -> DataFrame:
    """Pairs of distinct sets that share at least `share` of the smaller one."""
    from logsieve.session import cut_lineage

    ranked = _ranked(tokens)
    keep = F.col("size") - F.ceil(F.col("size") * share) + 1
    small = ranked.where(F.col("_pos") <= keep).select(F.col("set_id").alias("a_set"), F.col("size").alias("a_size"), "token")
    large = tokens.select(F.col("set_id").alias("b_set"), F.col("size").alias("b_size"), "token")
    first = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_set") < F.col("b_set")))
    candidates = cut_lineage(small.join(large, "token").where(first & (F.col("a_set") != F.col("b_set"))).select(*PAIR).distinct())
    return candidates.join(_shared(candidates, tokens), ["a_set", "b_set"]).where(F.col("shared") >= F.col("a_size") * share)


def set_overlap_pairs(df: DataFrame, key: str, token: str, over: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs of distinct sets above `over`, members of each set). Copies are members of one set."""
    members, tokens = distinct_sets(df, key, token)
    return jaccard_pairs(tokens, over), members


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def missing_values(expected: DataFrame, df: DataFrame, on: str) -> DataFrame:
    """Expected values that never occur."""
    return expected.select(on).distinct().join(df.select(on), on, "left_anti")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node of each component, by alternating large and small stars.

    A round links each node to the smallest node around it; the number of rounds grows
    with the logarithm of the longest path. Only a count and a checksum come to the driver.
    """
    from logsieve.session import cut_lineage

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, near: Column) -> DataFrame:
        lowest = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return e.join(lowest, "u").where(near & (F.col("v") != F.col("m"))).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )

    links = edges.where(F.col("u") != F.col("v")).select("u", "v").distinct()
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    previous = None
    for _ in range(max_rounds):
        large = star(both(links), F.col("v") > F.col("u")).distinct()
        # small star: every node hands its lower neighbours and itself to the lowest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = cut_lineage(small)
        state = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first()
        if previous == tuple(state):
            break
        previous = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
