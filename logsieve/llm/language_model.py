"""Scores of texts by a context-tree model of bytes and by word frequencies, both learned from training documents.

A byte is eight binary decisions. Each decision has a node for every depth of context, 0 to DEPTH previous bytes; a node
counts zeros and ones, and the context tree weighting mixes the Krichevsky-Trofimov estimates of all depths. All nodes of the
corpus are kept: grams (a byte with the bytes before it) are counted by a shuffle, and the subtree below each context of
SPLIT bytes is weighted in one place. What lies above has a fixed number of nodes and goes to every task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.store import written

DEPTH = 5
SPLIT = 3  # contexts of so many bytes are dealt over the tasks; above are at most 2**(8 * SPLIT) nodes
FREQUENT = 1 << 18  # words with at least 1 / FREQUENT of all tokens, of which there can't be more, are sent to every task
FREQUENT_GRAMS = 1 << 22  # likewise the scores of grams, 16 bytes each
PART_GRAMS = 1 << 15  # subtrees are taken in parts of about so many grams, for each of which some arrays of eight values are held
MERGE_GRAMS = 1 << 19  # counted grams wait for a merge until there are so many
HELD_GRAMS = 1 << 20  # merged grams that a task holds before it hands them over, 16 bytes each
HALF = math.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, for x > 0."""
    z = x + 8.0
    shift = np.zeros_like(z)
    for i in range(8):
        shift += np.log(x + i)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def level(depth: int) -> np.uint64:
    """The bits of a node's key at this depth: a byte for the decisions made so far, above it the context."""
    return np.uint64((1 << 8 * (depth + 1)) - 1)


def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node at the full depth, bit) of the eight decisions of each gram's last byte, as 8 x n."""
    byte, context = grams & np.uint64(255), grams & ~np.uint64(255)
    keys = np.stack([context | np.uint64(1 << i) | (byte >> np.uint64(8 - i)) for i in range(8)])
    return keys, np.stack([(byte >> np.uint64(7 - i)) & np.uint64(1) for i in range(8)]).astype(np.int64)


def text_grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(a gram for each byte and each end of text, bounds of the texts): the byte with `depth` bytes before it.

    A-Z count as a-z. Before a text lie zero bytes, and its end is a zero byte.
    """
    from logsieve.llm.words import LOWER

    m = len(offsets) - 1
    sizes = np.diff(offsets)
    start = offsets[:-1] + np.arange(m) * (depth + 1)
    padded = np.zeros(len(data) + m * (depth + 1), np.uint8)
    text_at = np.repeat(start + depth - offsets[:-1], sizes) + np.arange(len(data))
    padded[text_at] = LOWER[data]
    wide = padded.astype(np.uint64)
    grams = wide[depth:].copy()
    for j in range(1, depth + 1):
        grams |= wide[depth - j : len(wide) - j] << np.uint64(8 * j)
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    at = np.repeat(start - bounds[:-1], sizes + 1) + np.arange(bounds[-1])
    return grams[at], bounds


def _merge(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g, c = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[first], np.add.reduceat(c, first)


def _counting_grams(depth: int):
    """Per task (gram, its number in training, its number), merged as they come and handed over when many are held."""

    def run(batches):
        from logsieve.llm.words import text_chunks

        kept: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}

        def rows(held):
            grams, counts = kept[held]
            if grams:
                g, c = _merge(grams, counts)
                kept[held] = ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.zeros(len(c), np.int64) if held else c), pa.array(c)], ["gram", "c", "n"])

        waiting = {True: 0, False: 0}
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for flag in (False, True):
                for _, data, offsets in text_chunks(batch.column(0).filter(pa.array(held == flag))):
                    g, c = np.unique(text_grams(data, offsets, depth)[0], return_counts=True)
                    kept[flag][0].append(g)
                    kept[flag][1].append(c)
                    waiting[flag] += len(g)
                    if waiting[flag] > MERGE_GRAMS:
                        g, c = _merge(*kept[flag])
                        kept[flag], waiting[flag] = ([g], [c]), 0
                        if len(g) > HELD_GRAMS:
                            yield from rows(flag)
        for flag in (False, True):
            yield from rows(flag)

    return run


def weigh(keys, zeros, ones, below, depth: int, least: int):
    """Nodes of the depths from `depth` down to `least`: for each depth (keys, log odds of a one, weight of the own estimate).

    P(node) = (KT(node) + product of P(children)) / 2, at the last depth KT(node) alone (`below` None). Odds are NaN where
    nothing was seen. Also returned: keys, zeros, ones and log P of the nodes of the depth `least`.
    """
    levels = []
    for d in range(depth, least - 1, -1):
        keys, at = np.unique(keys & level(d), return_inverse=True)
        at = at.reshape(-1)
        zeros, ones = np.bincount(at, zeros, len(keys)), np.bincount(at, ones, len(keys))
        seen = zeros + ones > 0
        own = np.where(seen, kt_log(zeros, ones), 0.0)
        if below is None:
            whole, weight = own, np.ones_like(own)
        else:
            below = np.bincount(at, below, len(keys))
            whole = np.logaddexp(HALF + own, HALF + below)
            weight = np.exp(HALF + own - whole)
        levels.append((d, keys, np.where(seen, np.log((ones + 0.5) / (zeros + 0.5)), np.nan), weight))
        below = whole
    return levels, (keys, zeros, ones, below)


def mixed(keys: np.ndarray, bits: np.ndarray, levels, p: np.ndarray) -> np.ndarray:
    """Probability of the bits at the nodes, mixed upwards from `p`; nodes that saw nothing have no say."""
    sign = np.where(bits == 1, -1.0, 1.0)
    for d, nodes, odds, weight in levels:
        at = np.searchsorted(nodes, keys & level(d))
        own = 1.0 / (1.0 + np.exp(sign * odds[at]))
        both = np.where(np.isnan(p), own, weight[at] * own + (1.0 - weight[at]) * p)
        p = np.where(np.isnan(own), p, both)
    return p


def _subtrees(depth: int, split: int, top=None):
    """Over grams sorted by their last `split` context bytes: sums for the nodes above or, given those, scores of the grams."""

    def part(gram, c, n):
        grams = gram.view(np.uint64)
        keys, bits = decisions(grams)
        keys, bits, count = keys.reshape(-1), bits.reshape(-1), np.tile(c.astype(float), 8)
        levels, (nodes, zeros, ones, whole) = weigh(keys, count * (1 - bits), count * bits, None, depth, split)
        if top is None:
            nodes, at = np.unique(nodes & level(split - 1), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *(pa.array(np.bincount(at.reshape(-1), x, len(nodes))) for x in (zeros, ones, whole))], ["node", "zeros", "ones", "below"])
        p = mixed(keys, bits, [*levels, *top.value], np.full(len(keys), np.nan))
        score = np.log10(np.where(np.isnan(p), 0.5, p)).reshape(8, -1).sum(axis=0)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n), pa.array(score)], ["gram", "n", "score"])

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append([batch.column(i).to_numpy() for i in range(3)])
            size += batch.num_rows
            if size > PART_GRAMS:
                gram, c, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
                context = gram.view(np.uint64) & (level(split) ^ np.uint64(255))
                borders = np.flatnonzero(context[1:] != context[:-1])
                cut = int(borders[-1]) + 1 if len(borders) else 0
                if cut:
                    yield part(gram[:cut], c[:cut], n[:cut])
                waiting, size = [[gram[cut:], c[cut:], n[cut:]]], 0  # a group goes on with the next rows
        if waiting:
            rows = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            if len(rows[0]):
                yield part(*rows)

    return run


def score_grams(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, score) of the distinct grams (gram, c, n): log10 probability of the last byte after the others.

    The model is learned from the counts `c`; n is handed on. Only the nodes above the split come to the driver: at most
    2**(8 * SPLIT), 32 bytes each, and far fewer where bytes are those of text.
    """
    spark, split = grams.sparkSession, min(SPLIT, depth)
    context = F.shiftrightunsigned("gram", 8).bitwiseAND((1 << 8 * split) - 1)
    dealt = grams.select("gram", "c", "n").repartition(context).sortWithinPartitions(context)
    summed = dealt.mapInArrow(_subtrees(depth, split), "node long, zeros double, ones double, below double").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    above = summed.select("node", "zeros", "ones", "below").toArrow()
    node, zeros, ones, below = (above.column(i).to_numpy() for i in range(4))
    levels, _ = weigh(node.astype(np.int64).view(np.uint64), zeros, ones, below, split - 1, 0)
    return dealt.mapInArrow(_subtrees(depth, split, spark.sparkContext.broadcast(levels)), "gram long, n long, score double")


def _counting(batches):
    """(word hash, count), folded per chunk, and the end of each text as the word 0."""
    from logsieve.llm.words import text_chunks, word_hashes

    for batch in batches:
        for _, data, offsets in text_chunks(batch.column(0)):
            h, c = np.unique(word_hashes(data, offsets)[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, END)), pa.array(np.append(c, len(offsets) - 1).astype(np.int64))], ["word", "c"])


END = np.int64(0)  # the hash that stands for the end of a text


RARE = pa.struct([("is_gram", pa.bool_()), ("key", pa.int64()), ("n", pa.int32())])


def _looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(value or 0, found) of sorted keys."""
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    found = table[0][at] == keys
    return np.where(found, table[1][at], 0.0), found


def _per_text(keys: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, number) of the distinct keys of each text."""
    order = np.lexsort((keys, which))
    keys, which = keys[order], which[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (which[1:] != which[:-1]))))
    return which[first], keys[first], np.diff(np.append(first, len(keys)))


def _scoring(frequent, depth: int):
    """Per text: place (unique), id, counts, the parts of both scores from frequent words and grams, and the rare ones."""

    def run(batches):
        from logsieve.llm.words import text_chunks, word_hashes

        words, grams = frequent.value
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                m = len(offsets) - 1
                h, bounds = word_hashes(data, offsets)
                distinct, back = np.unique(h.view(np.int64), return_inverse=True)
                value, known = _looked_up(distinct, words)
                value, known = np.where(known, value, math.log10(0.5))[back], known[back]
                base, hits = np.concatenate(([0.0], np.cumsum(value)))[bounds], np.concatenate(([0], np.cumsum(known)))[bounds]
                g, ends = text_grams(data, offsets, depth)
                each, back_g = np.unique(g.view(np.int64), return_inverse=True)
                value, found = _looked_up(each, grams)
                score = np.concatenate(([0.0], np.cumsum(value[back_g])))[ends]
                texts = np.arange(m)
                missing = np.flatnonzero(~known)
                missing_g = np.flatnonzero(~found[back_g])
                a = _per_text(distinct[back[missing]], np.repeat(texts, np.diff(bounds))[missing])
                b = _per_text(each[back_g[missing_g]], np.repeat(texts, np.diff(ends))[missing_g])
                text, key, n = (np.concatenate(x) for x in zip(a, b, strict=True))
                kind = np.repeat([False, True], [len(a[0]), len(b[0])])
                order = np.argsort(text, kind="stable")
                inner = pa.StructArray.from_arrays([pa.array(kind[order]), pa.array(key[order]), pa.array(n[order].astype(np.int32))], fields=list(RARE))
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[order], np.arange(m + 1)).astype(np.int32)), inner)
                numbers = [np.diff(bounds), np.diff(hits), np.diff(base), np.diff(score), np.diff(ends)]
                yield pa.RecordBatch.from_arrays([pa.array(place + texts), batch.column(0).slice(row, m), *map(pa.array, numbers), rare], ["place", "id", "words", "hits", "base", "score", "symbols", "rare"])
                place += m

    return run


def _sorted_values(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two columns, key and value, as arrays sorted by key; never empty."""
    table = rows.toArrow()
    if not table.num_rows:
        return np.array([END]), np.zeros(1)
    keys, values = (table.column(i).to_numpy() for i in range(2))
    order = np.argsort(keys)
    return keys[order], values[order]


def score_documents(docs: DataFrame, folds: int = 5, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Documents with crc32(id as text) modulo `folds` equal to `held_fold` are held out, the others are learned from. Scores
    are log10 probabilities: `base_score` of the words and the end by smoothed frequency, `score` of the bytes (A-Z as a-z)
    and the end by context-tree weighting. bits_per_byte is the code length per byte, the end among the bytes.

    Null texts are empty: one token, the end. Rows with a null id are learned from. Repeated rows count as often as they
    come, in learning too, and are scored alike. Other columns are ignored; an empty table gives no rows, and a table without
    training documents scores every decision by one half. Ids must be integers.

    Words are 64-bit hashes. Frequent words and grams (at most FREQUENT and FREQUENT_GRAMS, since each has that share of all)
    are looked up in every task; the others meet their values in a join, where no key is hot any more. Nodes and scores of
    all grams are tables that grow with the corpus.
    """
    spark = docs.sparkSession
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    held = F.coalesce(F.crc32(id_.cast("string")) % folds == held_fold, F.lit(False))
    source = docs.select(id_.alias("id"), text.alias("text"), held.alias("held"))
    counts = written(source.where(~F.col("held")).select("text").mapInArrow(_counting, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    end_count = F.coalesce(F.sum(F.when(F.col("word") == int(END), F.col("c"))), F.lit(0))
    tokens, vocabulary, end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), end_count).first()
    gram_counts = source.select("text", "held").mapInArrow(_counting_grams(depth), "gram long, c long, n long").groupBy("gram").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    grams = written(score_grams(written(gram_counts, "grams"), depth), "gram-scores")
    symbols = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    often, often_grams = F.col("c") >= max(1.0, tokens / FREQUENT), F.col("n") >= max(1.0, symbols / FREQUENT_GRAMS)
    gain = F.log10(F.col("c") + 0.5)
    frequent = spark.sparkContext.broadcast((_sorted_values(counts.where(often).select("word", gain)), _sorted_values(grams.where(often_grams).select("gram", "score"))))
    schema = "place long, id long, words long, hits long, base double, score double, symbols long, rare array<struct<is_gram: boolean, key: long, n: int>>"
    scored = written(source.select("id", "text").mapInArrow(_scoring(frequent, depth), schema), "scores")

    none = F.lit(0.0)
    values = counts.where(~often).select(F.lit(False).alias("is_gram"), F.col("word").alias("key"), F.lit(1).alias("hit"), (gain - math.log10(0.5)).alias("to_base"), none.alias("to_score"))
    values = values.unionByName(grams.where(~often_grams).select(F.lit(True).alias("is_gram"), F.col("gram").alias("key"), F.lit(0).alias("hit"), none.alias("to_base"), F.col("score").alias("to_score")))
    more = scored.select("place", F.inline("rare")).join(values, ["is_gram", "key"]).groupBy("place")
    more = more.agg(*(F.sum(F.col("n") * F.col(c)).alias(f"more_{c}") for c in ("hit", "to_base", "to_score")))
    met = scored.drop("rare").join(more, "place", "left")
    spread = math.log10(tokens + 0.5 * (vocabulary + 1))
    n_tokens = F.col("words") + 1
    base = F.col("base") + F.coalesce("more_to_base", none) + math.log10(end + 0.5) - n_tokens * spread
    score = F.col("score") + F.coalesce("more_to_score", none)
    return met.select(
        F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held_fold, F.lit(False)).alias("held_out"), n_tokens.alias("n_tokens"),
        (F.col("hits") + F.coalesce("more_hit", F.lit(0)) + int(end > 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), (-score / math.log10(2) / F.col("symbols")).alias("bits_per_byte"),
    )
