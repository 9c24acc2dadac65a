"""Texts that are nearly the same, exactly: Jaccard similarity of word shingles above a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.rows import bind
from logsieve.operators import textsets
from logsieve.operators.overlap import PAIR, _possible, _sides, connected_components
from logsieve.session import cut_lineage

SHINGLE_WORDS = 3


def shingles(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of runs of `size` words; a shorter text is one shingle."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(bound: Column) -> Column:
        last = F.greatest(F.size(bound) - size + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(bound, i, size), " ")))

    return F.array_distinct(bind(words, runs))


def near_duplicate_classes(df: DataFrame, key: str, text: str, over: float = 0.8, size: int = SHINGLE_WORDS) -> DataFrame:
    """(key, set_id, class_id) of every text with a word.

    `set_id` is the smallest key with the same shingles, `class_id` the smallest key reachable over texts that are similar
    above the threshold. As many rows as texts, however large a group of near copies is.

    Exact without all pairs: the sets of a shingle that many hold meet its first set only, then those that are still in
    different classes meet each other: a pair within one class could not change the result.
    """
    texts = textsets.texts_by_key(df, key, text)
    members, heads = textsets.named_sets(texts, size)
    met = cut_lineage(textsets.met_in_prefixes(texts, size, over, textsets.SMALL_GROUP))
    first = cut_lineage(textsets.by_name(met.where(F.col("b").isNotNull()), heads))

    def links(pairs: DataFrame) -> DataFrame:
        return textsets.similar(pairs, texts, heads, size, over).select(F.col("a_set").alias("u"), F.col("b_set").alias("v"))

    def classes(edges: DataFrame) -> DataFrame:
        found = connected_components(edges)
        return heads.join(found, F.col("set_id") == F.col("node"), "left").select("set_id", "_x", F.coalesce("component", "set_id").alias("class_id"))

    known = links(first)
    crowded = met.where(F.col("b").isNull()).select("h", F.col("a").alias("_x"), F.col("n").alias("size"), F.col("pos").alias("_pos"))
    placed = cut_lineage(crowded.join(classes(known), "_x"))
    mixed = placed.groupBy("h").agg(F.min("class_id").alias("_least"), F.max("class_id").alias("_most")).where("_least < _most").select("h")
    rows = placed.join(mixed, "h", "left_semi").select(F.col("h").alias("token"), "set_id", F.col("size").cast("long").alias("size"), F.col("_pos").cast("long").alias("_pos"), "class_id")
    a, b = _sides(rows, "class_id")
    crossing = a.join(b, "token").where((F.col("a_set") < F.col("b_set")) & (F.col("a_class_id") != F.col("b_class_id")) & _possible(over)).select(*PAIR).distinct()
    more = links(cut_lineage(crossing.join(first, ["a_set", "b_set"], "left_anti")))
    return members.join(classes(known.union(more)), "set_id").select(F.col("_k").alias(key), "set_id", "class_id")


def near_duplicates(df: DataFrame, key: str, text: str, over: float = 0.8, size: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(pairs of distinct texts above the threshold, members of each text).

    Texts with the same shingles are one text with many members, so a pile of copies is
    never paired with itself. Pairs are named by the smallest key of either side.
    """
    texts = textsets.texts_by_key(df, key, text)
    members, heads = textsets.named_sets(texts, size)
    candidates = cut_lineage(textsets.by_name(textsets.met_in_prefixes(texts, size, over), heads))
    pairs = textsets.similar(candidates, texts, heads, size, over)
    # a set is named by its smallest key
    sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n"))
    left = sizes.select(F.col("set_id").alias("a_set"), F.col("_n").alias("first_members"))
    right = sizes.select(F.col("set_id").alias("b_set"), F.col("_n").alias("second_members"))
    named = pairs.join(left, "a_set").join(right, "b_set")
    out = named.select(
        F.col("a_set").alias("first_key"), F.col("b_set").alias("second_key"), "first_members", "second_members", "similarity"
    )
    return out, members.withColumnRenamed("_k", key)
