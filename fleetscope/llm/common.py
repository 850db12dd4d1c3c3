"""Helpers shared by the operators: stored intermediate tables, hashed words, sliding minima."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_CACHE = 400_000  # words whose hash a worker remembers


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session inside one JVM may go without it; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that lost executors cost nothing already done."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(name: str = "text") -> Column:
    """The text as stored; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; whatever else the table holds can't clash with an operator's own."""
    return df.select(*names)


# Arrow ------------------------------------------------------------------------------------------------------------


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the 64-bit offsets of its rows; a null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count and lengths[~np.asarray(column.is_valid())].any():
        return batch_bytes(column.fill_null(b""))
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column whose rows take ``lengths`` values each."""
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), pa.array(values, kind))


# words and minima -------------------------------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hash per word, remembered for ``WORD_CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


def mix(values: np.ndarray) -> np.ndarray:
    """Invertible mixing of 64-bit values (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Order-aware hash of each run of ``k`` neighbours: ``len - k + 1`` values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9FB21C651E98DF25) + values[i : i + n]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` neighbours, by doubling."""
    n, out, span = len(values) - w + 1, values, 1
    if n <= 0:
        return values[:0]
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[w - span : w - span + n])
