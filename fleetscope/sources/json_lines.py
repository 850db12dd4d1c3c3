"""JSON lines with one definition of a bad one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows that fit ``schema``, and the text (``value``) of all other lines.

    A line is bad if it isn't a JSON object or a field has the wrong type: each line, save blank ones, is in one of the two.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("r"))
    is_bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.filter(~is_bad).select("r.*").drop(CORRUPT), parsed.filter(is_bad).select("value")
