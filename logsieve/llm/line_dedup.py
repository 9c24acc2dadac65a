"""Lines that many documents share, found with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.rows import bind, explode_computed
from logsieve.llm.store import fresh_path, written

RUN_SCHEMA = "line_hash binary, n_docs long, last_doc long"


WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(line: Column, min_chars: int) -> Column:
    """128-bit hash of the line's key; null for keys that are too short."""
    return bind(line_key(line), lambda key: F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key))))


class LineRuns:
    """Line hashes seen so far, as runs sorted by hash, in levels of a folder; a hash lives in one run only.

    A batch meets the live runs in a merge join: lines that no run holds become a run of level 0, the others are written
    beside it as counts to add. A level that holds `fanout` runs is compacted into one run of the next level, so a hash
    is rewritten a logarithmic number of times. Files are never changed and the list of live runs (a few paths) is on the
    driver, so what a lost task or a failed write left is never read.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 3):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)

    def runs(self) -> DataFrame:
        return self._read([path for level in self.levels for path in level])

    def _keep(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch of (line_hash, doc) rows, no document of which came before; returns its lines not seen before."""
        own = batch.distinct().groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        seen = self.runs().select("line_hash", F.lit(True).alias("again"))
        marked = own.join(seen.hint("merge"), "line_hash", "left").withColumn("again", F.col("again").isNotNull())
        path = f"{self.folder}/batch-{uuid.uuid4().hex}"
        marked.sortWithinPartitions("again", "line_hash").write.partitionBy("again").parquet(path)
        for folder in (f"{path}/again=false", f"{path}/again=true"):
            if self._exists(folder):
                if folder.endswith("false"):
                    self._keep(folder, 0)
                else:
                    self.repeats.append(folder)
        new = self._read([f"{path}/again=false"] if self._exists(f"{path}/again=false") else [])
        self._compact()
        return new

    def _exists(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            path = f"{self.folder}/level-{level + 1}-{uuid.uuid4().hex}"
            n = max(1, self.spark.sparkContext.defaultParallelism)
            self._read(self.levels[level]).repartitionByRange(n, "line_hash").sortWithinPartitions("line_hash").write.parquet(path)
            self.levels[level] = []
            self._keep(path, level + 1)
            level += 1

    def counts(self) -> DataFrame:
        """One row per line hash: number of documents and the largest document, over all batches."""
        both = self.runs().unionByName(self._read(self.repeats))
        return both.groupBy("line_hash").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def take_batches(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int, fanout: int) -> tuple[DataFrame, LineRuns]:
    """((line_hash, place, doc, row) of every line that is long enough, the runs over all of them)."""
    spark = docs.sparkSession
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    marked = F.transform(lines_of(text), lambda line, place: F.struct(hashed(line, min_chars).alias("line_hash"), place.alias("place")))
    rows = explode_computed(
        docs.where(doc.isNotNull()),
        [doc.alias("doc"), F.xxhash64(text).alias("row"), F.pmod(F.xxhash64(doc), F.lit(batches)).cast("int").alias("batch")],
        F.filter(marked, lambda m: m["line_hash"].isNotNull()),
        "line",
    ).select("doc", "row", "batch", "line.line_hash", "line.place")
    table = written(rows, "lines", "batch")
    runs = LineRuns(spark, fresh_path(spark, "line-runs"), fanout)
    for n in range(batches):
        runs.add(table.where(F.col("batch") == n).select("line_hash", "doc"))
    return table, runs


def dedup_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with lines removed that at least `min_docs` documents hold, except in the document of the largest id.

    Adds `n_lines` (before) and `n_dropped`; the text column holds the kept lines joined by a line feed. A line counts by
    its key (`line_key`), of at least `min_chars` code points. Documents come in `batches`; each adds a run of line hashes
    (`LineRuns`). Counts are over all batches, so the order of batches does not matter.

    Null and empty texts are one empty line. Rows of one id are one document in the counts; rows whose id is null are not
    counted and keep all lines. Ids must be integers. Columns named n_lines or n_dropped are replaced, others pass through.
    If every line goes, the text is empty. A line held by a third of all documents is one row per task after map-side
    aggregation; its rows in the join with the shared lines are split by adaptive execution.
    """
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    table, runs = take_batches(docs, id_col, text_col, min_chars, batches, fanout)
    frequent = runs.counts().where(F.col("n_docs") >= min_docs).select("line_hash", "last_doc")
    drops = (
        table.join(frequent, "line_hash").where(F.col("doc") != F.col("last_doc"))
        .groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.collect_list("place").alias("__places"))
    )
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    met = docs.join(drops.hint("shuffle_hash"), (doc == F.col("__doc")) & (F.xxhash64(text) == F.col("__row")), "left")
    lines, dropped = lines_of(text), F.array_distinct("__places")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__places")), lambda i: F.get(F.col("__lines"), i))
    rows = met.withColumn("__lines", lines).select(
        *(F.col(f"`{c}`") if c != text_col else F.when(F.col("__places").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n")).alias(c) for c in others),
        F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return rows
