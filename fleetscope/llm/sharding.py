"""Histogram sort: documents of a key order cut into shards of near equal bytes, exchanged once.

The key is (60-bit hash of the text, doc_id), so copies of a text are neighbours. Candidate boundaries are the borders of
4096 equal slices of the key range. One pass counts the exact bytes in each slice; slices that hold a wanted cut are cut
into 4096 again, until every splitter is within ``tolerance`` of its target. The document-id part of the key is looked at
only where one text alone is larger than the tolerance, so smaller groups of copies are never torn apart.

Defined results: a null text counts as empty (size 1), a null doc_id as the smallest id. Rows that agree in text and
doc_id stay in one shard. An empty table gives no rows. Columns of the input are kept, except ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.llm.common import partitions, stored, text_column

DIGIT = 12  # bits by which one round refines a slice
HASH_BITS = 60
ID_BITS = 64
LOWEST = -(1 << 63)
BIN_ROWS = 20_000  # rows that one numbering window should hold
LEAST_BINS = 64


def _key(id_column: str) -> tuple[Column, Column, Column]:
    text = text_column()
    high = F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    low = F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST))
    return high, low, (F.octet_length(text) + 1).cast("long")


def _digit(level: int) -> Column:
    """The ``level``-th group of key bits, high bits first; ids are shifted so that they order as unsigned numbers."""
    shift = (level + 1) * DIGIT
    if shift <= HASH_BITS:
        return F.shiftrightunsigned("_high", HASH_BITS - shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
    shift -= HASH_BITS
    flipped = F.col("_low").bitwiseXOR(F.lit(LOWEST))
    if shift <= ID_BITS:
        return F.shiftrightunsigned(flipped, ID_BITS - shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
    return flipped.bitwiseAND(F.lit((1 << (ID_BITS % DIGIT)) - 1))


LEVELS = HASH_BITS // DIGIT + -(-ID_BITS // DIGIT)


def _bits(level: int) -> int:
    return ID_BITS % DIGIT if level == LEVELS - 1 else DIGIT


def _inside(prefix: int, level: int) -> Column:
    """Whether a key begins with the digits in ``prefix`` (those before ``level``)."""
    used = sum(_bits(i) for i in range(level))
    high, low = (prefix, None) if used <= HASH_BITS else (prefix >> (used - HASH_BITS), prefix & ((1 << (used - HASH_BITS)) - 1))
    first = F.shiftrightunsigned("_high", HASH_BITS - min(used, HASH_BITS)) == F.lit(high)
    if low is None:
        return first
    flipped = F.col("_low").bitwiseXOR(F.lit(LOWEST))
    return first & (F.shiftrightunsigned(flipped, HASH_BITS + ID_BITS - used) == F.lit(low))


def splitters(light: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], int, int]:
    """Cuts (high, low) of the key order, rows and bytes in all.

    At most ``(shards - 1) * 4096`` sums reach the driver in a round, whatever the input holds.
    """
    rows, total = light.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    slack = tolerance * total / shards
    # a slice is (level, prefix): the digits fixed so far; below: bytes before the slice
    waiting = {cut: (0, 0) for cut in range(1, shards)} if rows else {}
    below: dict[tuple[int, int], int] = {(0, 0): 0}
    found: dict[int, tuple[int, int]] = {}
    level = 0
    while waiting:
        prefixes = sorted({prefix for _, prefix in waiting.values()})
        sizes: dict[int, dict[int, int]] = {p: {} for p in prefixes}
        slice_of = F.coalesce(*[F.when(_inside(p, level), F.lit(n)) for n, p in enumerate(prefixes)]) if level else F.lit(0)
        counted = light.withColumn("_slice", slice_of).filter("_slice is not null").groupBy("_slice", _digit(level).alias("_digit"))
        for n, digit, size in counted.agg(F.sum("_size")).collect():
            sizes[prefixes[n]][digit] = size
        after: dict[int, tuple[int, int]] = {}
        for cut, (_, prefix) in waiting.items():
            target, passed = total * cut / shards, below[(level, prefix)]
            for digit in sorted(sizes[prefix]):
                if passed + sizes[prefix][digit] > target:
                    break
                passed += sizes[prefix][digit]
            else:
                digit += 1
            size, here = sizes[prefix].get(digit, 0), (prefix << _bits(level)) + digit
            nearer = min((target - passed, here), (passed + size - target, here + 1))
            if nearer[0] <= slack or level + 1 == LEVELS or size == 0:
                found[cut] = (level, nearer[1])
            else:
                after[cut] = (level + 1, here)
                below[(level + 1, here)] = passed
        waiting, level = after, level + 1
    return [_cut(*found[c]) for c in sorted(found)], rows, total


def _cut(level: int, prefix: int) -> tuple[int, int]:
    used = sum(_bits(i) for i in range(level + 1))
    key = prefix << (HASH_BITS + ID_BITS - used)
    return key >> ID_BITS, (key & ((1 << ID_BITS) - 1)) + LOWEST


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within a shard).

    The bytes of a shard (of texts in UTF-8, one more for each) are equal up to twice ``tolerance`` of a shard and one row.
    """
    docs = docs.drop("shard", "slot")
    high, low, size = _key(id_column)
    light = stored(docs.select(high.alias("_high"), low.alias("_low"), size.alias("_size")), "shard-keys")
    cuts, rows, _ = splitters(light, shards, tolerance)
    bins = max(LEAST_BINS, rows // (shards * BIN_ROWS))

    def place(df: DataFrame) -> DataFrame:
        passed = sum((F.when((F.col("_high") > h) | ((F.col("_high") == h) & (F.col("_low") >= d)), 1).otherwise(0) for h, d in cuts), F.lit(0))
        return df.withColumn("shard", passed.cast("int")).withColumn("_bin", F.pmod(F.xxhash64("_low", "_high"), F.lit(bins)))

    before = W.partitionBy("shard").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    counts = place(light).groupBy("shard", "_bin").agg(F.count("*").alias("_n"))
    bases = counts.select("shard", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = place(docs.withColumns({"_high": high, "_low": low})).repartition(max(shards, partitions(docs.sparkSession)), "shard", "_bin")
    number = F.row_number().over(W.partitionBy("shard", "_bin").orderBy("_low", "_high"))
    numbered = placed.withColumn("_row", number).join(bases, ["shard", "_bin"])
    return numbered.withColumn("slot", F.col("_base") + F.col("_row") - 1).select(*docs.columns, "shard", "slot")
