"""Store of recorded runs: parquet partitioned by cluster and run, deletions as tombstones until compaction."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetscope.operators.skew import skew_join
from fleetscope.sources.json_lines import read_json_lines

RUN = ["cluster_id", "run_id"]
TOMBSTONES = "tombstones"
WARNED = 20
ROWS_PER_FILE = 1 << 20  # of a compacted run, about


class RunStore:
    """``root/v<N>/<table>`` holds the rows, ``root/v<N>/tombstones`` the deleted runs.

    Writers append; ``compact`` writes the rows that are left into the next version, so a
    failed job never leaves a half-deleted store. Ids are text whatever they look like.
    A file that can't be read costs its own rows only; ``unreadable`` names such files, and ``runs`` warns of them.
    """

    def __init__(self, spark: SparkSession, root: str, version: int = 0):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def _path(self, table: str) -> str:
        return f"{self.root}/v{self.version}/{table}"

    def _read(self, table: str) -> DataFrame | None:
        """The table, or ``None`` if nothing was saved. Ids are partition folders, whose types Spark would guess."""
        try:
            # the columns of all readable files, since the first one met may be broken
            found = self._reader().option("mergeSchema", "true").parquet(self._path(table))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        if table == TOMBSTONES:
            return found
        fields = [f for f in found.schema.fields if f.name not in RUN]
        return self._reader().schema(StructType([*fields, *[StructField(c, StringType()) for c in RUN]])).parquet(self._path(table))

    def _reader(self) -> DataFrameReader:
        return self.spark.read.option("ignoreCorruptFiles", "true")

    def save(self, table: str, rows: DataFrame, files: int | None = 1) -> None:
        """Append the rows of finished runs. A run's rows are dealt over ``files`` tasks, by their content; without a number over as
        many as its rows call for."""
        rows = rows.select(*[F.col(c).cast("string").alias(c) if c in RUN else c for c in rows.columns])
        content = F.xxhash64(*[c for c in rows.columns if c not in RUN and not c.startswith("_")])
        if files is None:
            sizes = rows.groupBy(*RUN).agg(F.ceil(F.count("*") / ROWS_PER_FILE).alias("_files"))
            rows = skew_join(rows, sizes, RUN, "inner")
        spread = F.pmod(content, F.lit(files) if files is not None else F.col("_files"))
        dealt = rows.withColumn("_deal", spread).repartition(*RUN, "_deal").drop("_deal", "_files")
        dealt.write.mode("append").partitionBy(*RUN).parquet(self._path(table))

    def unreadable(self, table: str) -> DataFrame:
        """``path`` of the files of a table whose rows a scan can't read.

        Files are listed by name and held against those that a scan without columns, which opens no more than their ends, gets rows from.
        """
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        files = listed.load(self._path(table)).select("path", F.element_at(F.split("path", "/"), -1).alias("_name"))
        rows = self._read(table)
        if rows is None:
            return files.select("path")
        read = rows.select(F.col("_metadata.file_name").alias("_name")).distinct()
        return files.join(read, "_name", "left_anti").select("path")

    def scan(self, table: str, cluster_id: str | None = None) -> DataFrame:
        """Rows of all runs, or of one cluster (partition-pruned), without deleted runs."""
        rows = self._read(table)
        if rows is None:
            raise ValueError(f"no table {table} in {self._path('')}")
        if cluster_id is not None:
            rows = rows.filter(F.col("cluster_id") == cluster_id)
        dead = self._read(TOMBSTONES)
        return rows if dead is None else rows.join(dead.select(*RUN).distinct(), RUN, "left_anti")

    def runs(self, cluster_id: str | None = None) -> DataFrame:
        """Runs, newest first; warns of the first files that can't be read."""
        for row in self.unreadable("runs").limit(WARNED).collect():
            warnings.warn(f"run skipped, {row.path} can't be read", stacklevel=2)
        return self.scan("runs", cluster_id).orderBy(F.desc("start_tick"), "run_id")

    def lookup(self, table: str, cluster_id: str, run_id: str) -> DataFrame:
        """Rows of one run, none if it is unknown."""
        return self.scan(table, cluster_id).filter(F.col("run_id") == run_id)

    def delete(self, cluster_id: str, run_id: str) -> bool:
        """Delete a run; tells whether it existed."""
        found = self.lookup("runs", cluster_id, run_id).select(*RUN)
        existed = not found.isEmpty()
        if existed:
            found.write.mode("append").parquet(self._path(TOMBSTONES))
        return existed

    def compact(self, tables: list[str]) -> RunStore:
        """The next version, written without deleted runs."""
        after = RunStore(self.spark, self.root, self.version + 1)
        for table in tables:
            after.save(table, self.scan(table), files=None)
        return after


def read_run_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Runs saved as JSON lines: the readable ones, and the text of the unreadable ones."""
    return read_json_lines(spark, path, schema)
