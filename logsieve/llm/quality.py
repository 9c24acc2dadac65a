"""Quality rules whose cutoffs come from labelled documents with a bound on false rejections.

All work is in DataFrame expressions. Per text, word windows are compared inside the row (sorted hashes of the windows),
so no word is ever shuffled; what is shuffled is one short row per labelled document and one row per stratum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.rows import bind
from logsieve.llm.store import written

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
BROADCAST_STRATA = 10_000  # cutoffs of up to so many strata are sent to all tasks; more are joined


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose measure is over a cutoff. cutoffs: from the most lenient to the strictest."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols_per_word", "n_symbols / n_words", (0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    Rule("repeated_words", "n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("repeated_lines", "n_dup_lines / n_words", (0.1, 0.08, 0.06, 0.04, 0.03, 0.02)),
    Rule("upper_case", "n_upper / word_chars", (0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    Rule("exclamations", "n_exclaim / n_words", (0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05)),
    Rule("long_words", "word_chars / n_words", (16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
)


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash comes twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"]), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(p, start, lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")), lambda acc: acc["total"])

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(bind(placed, places), covered))


def measures(docs: DataFrame, keep: Sequence[Column], text_col: str = "text") -> DataFrame:
    """`keep` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_exclaim of the whole text.

    Windows of three words are equal if their 64-bit hashes are, which are compared within one text only.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(*keep, text.alias("__text"), words.alias("__words")).withColumn("n_words", F.size("__words").cast("long"))
    w = F.col("__words")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WINDOW))))
    body = F.col("__text")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    long = lambda c: c.cast("long")
    return rows.withColumn("__windows", F.when(F.size(w) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).select(
        *(F.col(f"`{c}`") for c in rows.columns if not c.startswith("__") and c != "n_words"),
        "n_words",
        long(_without(body, WHITE)).alias("word_chars"),
        long(F.char_length(body) - _without(body, SYMBOLS)).alias("n_symbols"),
        long(bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        long(_repeat_words(F.col("__windows"))).alias("n_repeat_words"),
        long(F.char_length(body) - _without(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        long(F.char_length(body) - _without(body, "!")).alias("n_exclaim"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8; error below 1e-12 for x >= 1."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + i)
    return series - shift


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), exact up to rounding; 1 where k >= n * rate, which no test passes.

    Below the mean the terms fall faster than geometrically, so what lies 12 standard deviations below k is nothing.
    """
    n, k = n.cast("double"), k.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    steps = F.least(k, 64 + F.ceil(12 * F.sqrt(n * rate)).cast("double")).cast("int")
    odds = (1 - rate) / rate
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j) * odds / (n - k + j + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    places = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(top) * F.aggregate(places, start, step, lambda acc: acc["total"]))


def certified_cutoffs(good: DataFrame, rules: Sequence[Rule], false_rejection: float, risk: float, n_strata: int) -> DataFrame:
    """One row per stratum with a cutoff for each rule, null where none is certified.

    `good` holds good labelled documents that pass the base: stratum and measures. A rule may reject at most
    `false_rejection` / number of rules of the good documents of a stratum. A cutoff is certified if, were the true share
    larger, so few rejected documents in the holdout would have a probability (exact binomial tail) of at most
    `risk` / (rules x strata). The cutoffs of a rule are tested from the most lenient on and testing ends at the first
    failure (fixed sequence), so the family-wise error over all rules, strata and cutoffs is at most `risk`, and all rules
    together falsely reject at most `false_rejection` in every stratum.
    """
    rate, level = false_rejection / len(rules), risk / (len(rules) * max(1, n_strata))
    over = [
        F.sum((F.expr(r.measure) > c).cast("long")).alias(f"over_{i}_{j}") for i, r in enumerate(rules) for j, c in enumerate(r.cutoffs)
    ]
    counted = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over)

    tests = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(j).alias("step"), F.col(f"over_{i}_{j}").alias("k")) for i, r in enumerate(rules) for j in range(len(r.cutoffs))))
    tested = counted.select("stratum", "n", F.explode(tests).alias("t")).select("stratum", "t.rule", "t.step", binomial_tail(F.col("n"), F.col("t.k"), rate).alias("p"))
    first_failure = [F.min(F.when((F.col("rule") == i) & (F.col("p") > level), F.col("step"))).alias(f"fail_{i}") for i in range(len(rules))]

    def strictest(i: int, rule: Rule) -> Column:
        return F.get(F.array(*(F.lit(c) for c in rule.cutoffs)), F.coalesce(F.col(f"fail_{i}"), F.lit(len(rule.cutoffs))) - 1).alias(f"cut_{rule.name}")

    return tested.groupBy("stratum").agg(*first_failure).select("stratum", *(strictest(i, r) for i, r in enumerate(rules)))


def joint_path(rules: Sequence[Rule]) -> list[tuple[int, ...]]:
    """Steps from the most lenient cutoffs of all rules to the strictest, one rule tightened at a time: a place per rule."""
    turns = sorted((j / (len(r.cutoffs) - 1), i) for i, r in enumerate(rules) for j in range(1, len(r.cutoffs)))
    steps = [(0,) * len(rules)]
    for _, i in turns:
        steps.append(tuple(c + (k == i) for k, c in enumerate(steps[-1])))
    return steps


def least_labels(false_rejection: float, risk: float, n_strata: int) -> int:
    """Good labels from which a stratum without a rejected one certifies a step of the path."""
    return math.ceil(math.log(risk / max(1, n_strata)) / math.log1p(-false_rejection))


def certified_path(good: DataFrame, rules: Sequence[Rule], false_rejection: float, risk: float) -> DataFrame:
    """One row per stratum of `good` with a cutoff for each rule, null where not even the first step is certified.

    The budget is spent once per stratum: a step of `joint_path` is certified if, were more than `false_rejection` of the
    good documents over any of its cutoffs, so few rejected ones in the holdout would have a probability of at most `risk` /
    strata with labels. The steps are tested in order and testing ends at the first failure, so the family-wise error is
    at most `risk`. With no good document rejected this takes `least_labels` of them (144 at 0.03, 0.05 and four strata).
    """
    steps = joint_path(rules)
    reached = {(i, c): s for s, at in reversed(list(enumerate(steps))) for i, c in enumerate(at)}  # the first step with this cutoff
    firsts = []
    for i, rule in enumerate(rules):
        first = F.lit(None).cast("int")
        for j, cutoff in reversed(list(enumerate(rule.cutoffs))):
            first = F.when(F.expr(rule.measure) > cutoff, F.lit(reached[i, j])).otherwise(first)
        firsts.append(first)
    over = [F.count_if(F.col("first") <= s).alias(f"over_{s}") for s in range(len(steps))]
    counted = good.select("stratum", F.array_min(F.array(*firsts)).alias("first")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over)
    counted = written(counted, "path")
    level = risk / max(1, counted.count())
    tests = F.posexplode(F.array(*(F.col(f"over_{s}") for s in range(len(steps))))).alias("step", "k")
    failed = binomial_tail(F.col("n"), F.col("k"), false_rejection) > level
    ends = counted.select("stratum", "n", tests).groupBy("stratum").agg(F.min(F.when(failed, F.col("step"))).alias("fail"))
    last = F.coalesce("fail", F.lit(len(steps))) - 1
    return ends.select("stratum", *(F.get(F.array(*(F.lit(r.cutoffs[at[i]]) for at in steps)), last).alias(f"cut_{r.name}") for i, r in enumerate(rules)))


def judge(
    docs: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, stratum_col: str = "lang", false_rejection: float = 0.03, risk: float = 0.05,
    id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, joint: bool = True,
) -> DataFrame:
    """One row per document: id, measures, base_failed, failed_rules and kept (with `keep_columns` all columns of docs).

    labels: doc_id and quality (1 is good). A document is good if all its labels are 1; rows with a null id or label do
    not count. Null texts have no words and fail the base, like empty ones. A null stratum is the stratum "". In a stratum
    without enough labels (`least_labels`) no cutoff is certified and only the base decides. Repeated rows are judged alike;
    columns of docs named like a result are left out. Empty tables give empty results. With `joint` all rules together are
    certified (`certified_path`), else each by its share of the budget (`certified_cutoffs`), which takes far more labels.
    """
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "stratum", "base_failed", "failed_rules", "kept")
    id_ = F.col(f"`{id_col}`")
    stratum = F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("")).alias("stratum")
    measured = measures(docs, [id_.alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("row"), stratum], text_col).withColumn("base_failed", base_failed())
    measured = written(measured, "quality")
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality") == 1)
    good = measured.where(~F.col("base_failed")).join(marks.select(F.col("doc_id").alias("id")), "id", "left_semi")
    n_strata = measured.select("stratum").distinct().count()
    cutoffs = certified_path(good, rules, false_rejection, risk) if joint else certified_cutoffs(good, rules, false_rejection, risk, n_strata)
    cutoffs = written(cutoffs, "cutoffs")
    if n_strata <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    failed = F.array_compact(F.array(*(F.when(F.expr(r.measure) > F.col(f"cut_{r.name}"), F.lit(r.name)) for r in rules)))
    met = measured.join(cutoffs, "stratum", "left").withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed))
    judged = met.select("id", "row", *results[:-2], "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
    if not keep_columns:
        return judged.drop("row").withColumnRenamed("id", id_col)
    kept = judged.where("kept").select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct()
    return docs.join(kept.hint("shuffle_hash"), id_.eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__row")), "left_semi")


