"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.scratch import kept, new_path, remove
from framelake.llm.text import ascii_lower, text_or_empty

KEY = ["k1", "k2"]
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_BLANKS)))


def _key_hash(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2"))


class LineRuns:
    """Sorted runs of (k1, k2, n, last): in how many documents a line was seen and the largest id among them.

    `add` merges one batch of (k1, k2, doc_id) rows: an anti-join with the runs tells the batch's new lines
    (`fresh`), and all its lines, summed up, become one more sorted run. When `fanout` runs stand on a level,
    they are compacted into one run of the next level, so n batches leave about fanout * log(n) runs. Runs are
    Parquet folders below the shared folder; a lost executor costs no more than the step that runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("k1 long, k2 long, n long, last long, fresh boolean").parquet(*paths)

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("fresh").alias("fresh"))

    def _write(self, run: DataFrame) -> str:
        path = new_path(self.spark, "line-run")
        run.sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def all_paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def add(self, occurrences: DataFrame) -> str:
        seen = occurrences.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        if paths := self.all_paths():
            known = self._read(paths).select(*KEY)
            fresh = seen.join(known, KEY, "left_anti").withColumn("fresh", F.lit(True))
            again = seen.join(known, KEY, "left_semi").withColumn("fresh", F.lit(False))
            run = fresh.unionByName(again)
        else:
            run = seen.withColumn("fresh", F.lit(True))
        written = self._write(run)
        self._place(written, 0)
        return written

    def _place(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged(self._read(self.levels[level])))
            remove(self.spark, self.levels[level])
            self.levels[level] = []
            self._place(merged, level + 1)

    def totals(self) -> DataFrame:
        return self._merged(self._read(self.all_paths()))


def dedup_lines(
    docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """The columns of `docs` with `text` cut, plus n_lines (before) and n_dropped.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys of `min_chars` code
    points or more in `min_docs` rows or more lose all lines except in the rows with the largest doc_id that has
    the key. `batches` is into how many parts (by id hash) the table is fed to the runs; the result is the
    same for any number. Null text counts as one empty line and becomes an empty text. A row counts once for a key however often
    it holds it. A null id counts and yields to any id; rows with equal ids are kept or cut alike. A name
    that clashes with n_lines or n_dropped is replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    lines = F.split(text_or_empty(), "\n", -1)
    long_lines = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars)
    hashes = F.transform(
        F.array_distinct(long_lines),
        lambda k: F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(7), k).alias("k2")),
    )
    id_of = F.col("doc_id").cast("long")
    found = docs.select(id_of.alias("doc_id"), F.explode(hashes).alias("h")).select(
        "doc_id", "h.*", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    )
    path = new_path(spark, "line-keys")
    found.write.partitionBy("batch").parquet(path)
    occurrences = spark.read.schema("doc_id long, k1 long, k2 long, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(occurrences.where(F.col("batch") == b))
    # Written, so that the join below has two plain inputs and can split the rows of a hot line.
    repeated = kept(runs.totals().where(F.col("n") >= min_docs).select(*KEY, "last"), "repeated-lines")
    losing = (
        occurrences.join(repeated, KEY)
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc_id").alias("losing_id"))
        .agg(F.collect_set(F.struct(*KEY)).alias("lost_keys"))
    )
    joined = docs.drop("n_lines", "n_dropped").join(losing, id_of.eqNullSafe(F.col("losing_id")), "left")
    left = F.when(F.col("lost_keys").isNull(), lines).otherwise(
        F.filter(
            lines,
            lambda line: (F.length(line) < min_chars) | ~F.array_contains(F.col("lost_keys"), _key_hash(line)),
        )
    )
    cut = joined.withColumn("kept_lines", left)
    return cut.select(
        *(F.array_join("kept_lines", "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("kept_lines")).cast("long").alias("n_dropped"),
    )
