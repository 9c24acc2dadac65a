"""Records of JSON files of any size: arrays and envelopes are read by split, like lines.

Files are read as fragments that end at a closing brace, which Spark's text source cuts at any split. Whether a fragment starts inside a
string, and how deep in braces and brackets it ends, are running sums over the fragments before it: sums of a split are taken under both
assumptions about its first character, the splits' sums are added up in order, and one join hands them back. A record ends
where the depth is that of its list, so the fragments between two such ends are one record, put together by a
shuffle on (file, number of the record). No task holds more than a split or a record.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.rows import explode_computed
from logsieve.operators.ordered import with_carry
from logsieve.session import cut_lineage

WHITE = r"[\s﻿]*"
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.DOTALL)


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, _block, _pos, text, braces, brackets, inside): fragments with the depth at their end.

    inside: the fragment ends within a string, so its brace is one of the text. Only the last fragment of a file can lack the
    brace; its depth is then below zero.
    """
    base = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos"), F.col("value").alias("text")
    )
    in_block = W.partitionBy("file_id", "_block").orderBy("_pos")
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    quoted = base.withColumn("_quotes", _count(plain, '"') % 2).withColumn("_odd", (F.sum("_quotes").over(in_block) - F.col("_quotes")) % 2)
    parts = F.split(plain, '"', -1)
    outside = [F.array_join(F.filter(parts, lambda p, i: i % 2 == (F.col("_odd") + start) % 2), " ") for start in (0, 1)]
    depths = {}
    for start, text in enumerate(outside):
        ends_outside = (F.col("_odd") + start + F.col("_quotes")) % 2 == 0
        depths[f"_braces{start}"] = _count(text, "{") - F.when(ends_outside, 1).otherwise(0)
        depths[f"_brackets{start}"] = _count(text, "[") - _count(text, "]")
    measured = quoted.withColumns(depths)
    before = W.partitionBy("file_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    per_block = measured.groupBy("file_id", "_block").agg(F.sum("_quotes").alias("_q"), *(F.sum(c).alias(c) for c in depths))
    per_block = per_block.withColumn("_start", F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2)
    sums = {k: F.when(F.col("_start") == 0, F.col(f"_{k}0")).otherwise(F.col(f"_{k}1")) for k in ("braces", "brackets")}
    per_block = per_block.withColumns({f"_sum_{k}": c for k, c in sums.items()})
    handed = per_block.select("file_id", "_block", "_start", *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_from_{k}") for k in sums))
    known = measured.join(handed, ["file_id", "_block"])
    running = {k: F.col(f"_from_{k}") + F.sum(c).over(in_block) for k, c in sums.items()}
    inside = (F.col("_start") + F.col("_odd") + F.col("_quotes")) % 2 == 1
    return known.select("file_id", "_block", "_pos", "text", *(c.alias(k) for k, c in running.items()), inside.alias("inside"))


def _raw_records(pieces: DataFrame) -> DataFrame:
    """(file_id, mode, record, raw, ended): the text of each record with what stands before it.

    mode: `array` (elements of a top-level list), `lines` (objects one after the other), `lists` (elements of the lists in
    a single object) or `object` (a single object without lists of objects).
    """
    at = lambda braces, brackets: ~F.col("inside") & (F.col("braces") == braces) & (F.col("brackets") == brackets)
    levels = {"lines": at(0, 0), "array": at(0, 1), "lists": at(1, 1)}
    whole = W.partitionBy("file_id")
    before = whole.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    first = F.regexp_extract(F.min_by("text", "_pos"), rf"^{WHITE}([\[{{])", 1)
    placed = with_carry(
        pieces, ["file_id"], "_block", {"_first": first, **{f"_{k}": F.count_if(c) for k, c in levels.items()}},
        {"_opens": F.first("_first").over(whole.orderBy("_block")), **{f"_all_{k}": F.sum(f"_{k}").over(whole) for k in levels}, **{f"_from_{k}": F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)) for k in levels}},
    )
    mode = F.when(F.col("_opens") == "[", "array").when(F.col("_opens") == "{", F.when(F.col("_all_lines") > 1, "lines").when(F.col("_all_lists") > 0, "lists").otherwise("object"))
    placed = placed.withColumn("mode", mode).where(F.col("mode").isNotNull())
    ends, start = F.lit(False), F.lit(0).cast("long")
    for k, c in levels.items():
        ends, start = F.when(F.col("mode") == k, c).otherwise(ends), F.when(F.col("mode") == k, F.col(f"_from_{k}")).otherwise(start)
    placed = placed.withColumns({"_ends": ends, "_from": start})
    earlier = W.partitionBy("file_id", "_block").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    text = F.when(F.col("braces") < 0, F.col("text")).otherwise(F.concat("text", F.lit("}")))
    numbered = placed.select(
        "file_id", "mode", "_block", "_pos", text.alias("text"), "_ends", (F.col("_from") + F.coalesce(F.sum(F.col("_ends").cast("int")).over(earlier), F.lit(0))).alias("record")
    )
    rows = F.array_sort(F.collect_list(F.struct("_block", "_pos", "text")))
    return numbered.groupBy("file_id", "mode", "record").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("raw"), F.max("_ends").alias("ended"))


def lists_of(raw: str, inside: bool) -> tuple[list[tuple[str | None, str]], int]:
    """((key, text of the elements) of the lists directly in the object, number of its keys) in a part of the object's text.

    inside: the text starts within such a list, whose key is then None.
    """
    depth = 2 if inside else 0
    start, name, last, keys, out = 0, None, None, 0, []
    open_list = inside
    for m in _TOKENS.finditer(raw):
        token = m[0]
        if token[0] == '"':
            if depth == 1 and raw[m.end() :].lstrip()[:1] == ":":
                last, keys = token, keys + 1
        elif token in "{[":
            depth += 1
            if token == "[" and depth == 2:
                open_list, name, start = True, json.loads(last or '""', strict=False), m.end()
        else:
            depth -= 1
            if depth == 1 and open_list and token == "]":
                out.append((name, raw[start : m.start()]))
                open_list = False
    if open_list:
        out.append((name, raw[start:]))
    return out, keys


def _splitting(batches):
    schema = pa.schema([("file_id", pa.string()), ("record", pa.int64()), ("part", pa.int32()), ("key", pa.string()), ("body", pa.string()), ("keys", pa.int32())])
    for batch in batches:
        rows = []
        for file_id, record, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found, keys = lists_of(raw, record > 0)
            rows += [(file_id, record, n, key, body, keys if n == 0 else 0) for n, (key, body) in enumerate(found or [(None, "")])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _elements(rows: DataFrame, body: Column) -> DataFrame:
    """(file_id, object): the elements written in `body`."""
    inner = F.regexp_replace(body, rf"^{WHITE},|,{WHITE}$", "")
    return explode_computed(rows, ["file_id"], F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>"), "object")


def read_json_records(spark: SparkSession, path: str | list[str], envelopes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """((file_id, object), (file_id, text)): elements of lists, and texts that are objects or lines as they stand.

    A file is a list, objects one after the other (JSON lines, or of several lines each), an envelope or one object. Of an envelope the list under
    the first of the names in `envelopes` counts that has elements, or that under its only key; an object with other lists comes out as a
    text. Elements of lists may be of any kind. Files that start with anything else have no records. The fragments are
    checkpointed, since the sums and the records read them.
    """
    raw = cut_lineage(_raw_records(cut_lineage(fragments(spark, path))))
    array = raw.where("mode = 'array'")
    own = F.regexp_replace("raw", rf"^{WHITE}[\[,]", "")
    in_arrays = _elements(array, F.when(F.col("ended"), own).otherwise(F.regexp_replace(own, r"\]\s*$", "")))

    listed = raw.where("mode = 'lists'")
    middle = F.col("ended") & F.col("raw").rlike(r"^\s*,") & (F.col("record") > 0)
    edges = listed.where(~middle).select("file_id", "record", "raw").mapInArrow(_splitting, "file_id string, record long, part int, key string, body string, keys int")
    edges = cut_lineage(edges)
    # few rows a file: where its lists start
    starts = edges.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("record", "part", "key")))).alias("starts"), F.sum("keys").alias("keys"), F.collect_set("key").alias("names")
    )
    named = [F.when(F.array_contains("names", e), F.lit(e)) for e in envelopes]
    chosen = F.coalesce(*named, F.when(F.col("keys") == 1, F.get("names", F.lit(0))))
    starts = starts.select("file_id", "starts", chosen.alias("chosen"))
    inside = listed.where(middle).select("file_id", "record", F.lit(-1).alias("part"), F.lit(None).cast("string").alias("key"), F.col("raw").alias("body"))
    bodies = edges.drop("keys").unionByName(inside).join(starts, "file_id")
    earlier = F.filter("starts", lambda s: s["record"] < F.col("record"))
    key = F.coalesce("key", F.element_at(F.transform(earlier, lambda s: s["key"]), -1))
    in_lists = _elements(bodies.where(F.col("chosen").isNotNull()).where(key == F.col("chosen")), F.col("body"))

    unnamed = listed.join(starts.where(F.col("chosen").isNull()), "file_id", "left_semi")
    rows = F.array_sort(F.collect_list(F.struct("record", "raw")))
    whole = unnamed.groupBy("file_id").agg(F.array_join(F.transform(rows, lambda r: r["raw"]), "").alias("text"))
    texts = raw.where("mode IN ('lines', 'object')").select("file_id", F.col("raw").alias("text"))
    trimmed = texts.unionByName(whole).select("file_id", F.regexp_replace("text", rf"^{WHITE}|{WHITE}$", "").alias("text"))
    return in_arrays.unionByName(in_lists), trimmed.where("text <> ''")
