"""Near-duplicate documents by the Jaccard similarity of their word 5-grams: a chosen-path join.

Documents with equal sets of grams are one set from the start. In each run a set walks down a tree: at every node all its sets
draw a token by the same random order of tokens (the least under a hash of the run and level), and those with the same token
go on together. A node of at most ``LEAF`` sets is compared in full; a larger one is split again, at most ``DEPTH`` times.
What is still larger then holds true copies mostly; its pairs are compared in full too, in squares of ``LEAF`` by ``LEAF``.

Two sets of similarity s stay together through d splits with probability s^d, so ``runs_for`` gives the number of runs that
reaches the target recall even for pairs at the threshold that are split ``DEPTH`` times; pairs split once are missed far
less often. A pair is counted in the first run whose leaf holds both sets: each set carries its leaves, so later runs know.
Leaves without a new pair are dropped before any grams are sent, as are sets without a partner of fitting size.

Links are never listed: squares send back a number of links and a spanning forest for each set, and connected components
give the classes. Gram sets are compared exactly (as 64-bit hashes of the grams).

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one gram; null and wordless texts have no
grams, no links and a class of their own. Repeated rows are copies of each other (a link each). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.llm.common import HASHES, batch_bytes, gram_hashes, mix, partitions, stored
from fleetscope.llm.components import components

WORDS = 5
LIKE = (4, 5)  # similarity of 4/5 or more
RECALL = 0.999
DEPTH = 3
LEAF = 256
NO_ID = -(1 << 63)


def runs_for(recall: float, similarity: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


def gram_set(text: bytes) -> np.ndarray:
    """Distinct grams of a text, in order."""
    words = text.split()
    n = min(len(words), WORDS)
    if not n:
        return np.zeros(0, np.uint64)
    grams = gram_hashes(HASHES.of(words), n)
    return np.unique(grams if n == WORDS else grams ^ np.uint64(n))


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = batch_bytes(column)
    raw = data.tobytes()
    return (raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))


def _set_id(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _sign(tokens: int):
    factors = mix(np.arange(1, tokens + 1, dtype=np.uint64)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, texts = batch.column(0), batch.column(1), _texts(batch.column(2))
            for at in range(0, batch.num_rows, 500):
                sets = [gram_set(t) for _, t in zip(range(500), texts, strict=False)]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                least = np.zeros((len(sets), tokens), np.int64)
                if len(full):
                    grams = np.concatenate(sets)
                    starts = (np.cumsum(sizes) - sizes)[full]
                    with np.errstate(over="ignore"):
                        for i, f in enumerate(factors):
                            order = (grams ^ (grams >> np.uint64(32))) * f
                            order ^= order >> np.uint64(29)
                            least[full, i] = np.minimum.reduceat(order * f, starts).view(np.int64)
                ids = [_set_id(s) if len(s) else None for s in sets]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, tokens), pa.int32()), pa.array(least.ravel()))
                part = slice(at, at + len(sets))
                yield pa.RecordBatch.from_arrays([keys[part], prints[part], pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), listed], ["_key", "_print", "set", "size", "tokens"])

    return sign


# leaves -----------------------------------------------------------------------------------------------------------


def _token(level: int) -> Column:
    return F.get("tokens", F.col("run") * DEPTH + level)


def _alive(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` whose node holds two sets or more, with the node's number of sets."""
    counts = stored(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), f"{name}-counts")
    return stored(rows.drop("n").join(counts, "node"), name)


def leaves(sets: DataFrame, runs: int, leaf: int) -> DataFrame:
    """``set, size, run, node, n``: the leaf of each set in each run, if it holds another set too."""
    rows = sets.select("set", "size", "tokens", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = rows.withColumn("node", F.xxhash64("run", _token(0)))
    own = F.slice("tokens", F.col("run") * DEPTH + 2, DEPTH - 1)
    rows = _alive(rows.select("set", "size", "run", own.alias("tokens"), "node"), "level-1")
    done = rows.filter(F.col("n") <= leaf)
    for level in range(1, DEPTH):
        large = rows.filter(F.col("n") > leaf)
        if large.isEmpty():
            break
        rows = _alive(large.withColumn("node", F.xxhash64("node", F.get("tokens", F.lit(level - 1)))), f"level-{level + 1}")
        done = done.unionByName(rows if level == DEPTH - 1 else rows.filter(F.col("n") <= leaf))
    return done.drop("tokens")


def with_news(rows: DataFrame, runs: int, leaf: int) -> DataFrame:
    """Leaves in which two sets may meet for the first time; ``met`` has the leaves of a set by run (0: none)."""
    by_run = F.map_from_entries(F.collect_list(F.struct("run", "node")))
    met = F.array(*[F.coalesce(F.try_element_at("_by", F.lit(r)), F.lit(0)) for r in range(runs)])
    known = rows.groupBy("set").agg(by_run.alias("_by")).select("set", met.alias("met"))
    rows = stored(rows.join(known, "set"), "leaves")
    least = [F.min(F.col("met")[i]).alias(f"_l{i}") for i in range(runs)]
    most = [F.max(F.col("met")[i]).alias(f"_m{i}") for i in range(runs)]
    old = F.lit(False)
    for i in range(runs):
        old = old | ((F.lit(i) < F.col("run")) & (F.col(f"_l{i}") == F.col(f"_m{i}")) & (F.col(f"_l{i}") != 0))
    fresh = stored(rows.groupBy("node", "run").agg(*least, *most).filter(~old).select("node", "run"), "fresh-leaves")
    rows = rows.join(fresh, ["node", "run"])
    p, q = LIKE
    near = W.partitionBy("node").orderBy("size", "set")
    before = F.coalesce(F.lag("size").over(near) * q >= F.col("size") * p, F.lit(False))
    after = F.coalesce(F.col("size") * q >= F.lead("size").over(near) * p, F.lit(False))
    small = rows.filter(F.col("n") <= leaf).withColumn("_fits", before | after).filter("_fits").drop("_fits")
    return small.unionByName(rows.filter(F.col("n") > leaf))


# comparison -------------------------------------------------------------------------------------------------------

SQUARE = "node long, run int, x int, y int, set binary, side int, copies long, met array<long>, grams binary"
FOUND = "set binary, links long, root binary"


def _send(side: int):
    """Sends the grams of each set once for every square of ``side`` sets that it takes part in."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SQUARE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        done: set[bytes] = set()  # rows repeated under one doc_id come to one task and send their set once
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for text, row in zip(_texts(batch.column(0)), batch.select(batch.schema.names[1:]).to_pylist(), strict=True):
                if row["set"] in done:
                    continue
                done.add(row["set"])
                packed = gram_set(text).tobytes()
                for leaf in row["leaves"]:
                    blocks = -(-leaf["n"] // side)
                    mine = int.from_bytes(row["set"][:8], "little") % blocks
                    for other in range(blocks):
                        values = [leaf["node"], leaf["run"], min(mine, other), max(mine, other), row["set"], int(mine > other), row["copies"], row["met"], packed]
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                        size += len(packed)
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                            out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return send


def like_pairs(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of sets that are similar enough, by counting shared grams."""
    p, q = LIKE
    sizes = np.array([len(g) for g in grams])
    if len(grams) == 2:
        shared = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
        like = q * shared >= p * (sizes.sum() - shared)
        return np.zeros(int(like), np.int64), np.ones(int(like), np.int64)
    flat, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    ends = np.flatnonzero(np.concatenate([flat[1:] != flat[:-1], [True]])) + 1
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.zeros((len(grams), len(grams)), np.int32)
    of = np.repeat(np.arange(len(ends)), ends - starts)
    held = np.argsort(owner, kind="stable")
    bounds = np.cumsum(sizes)
    for i in range(len(grams)):
        groups = of[held[bounds[i] - sizes[i] : bounds[i]]]
        n = ends[groups] - starts[groups]
        groups, n = groups[n > 1], n[n > 1]
        places = np.repeat(starts[groups] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        counts[i] = np.bincount(owner[places], minlength=len(grams))
    i, j = np.nonzero(np.triu(q * counts.astype(np.int64) >= p * (sizes[:, None] + sizes[None, :] - counts), 1))
    return i, j


def _compare_square(rows: list[dict]) -> list[tuple]:
    unique = {r["set"]: r for r in rows}  # repeated documents send their set again
    rows = list(unique.values())
    if len(rows) < 2:
        return []
    i, j = like_pairs([np.frombuffer(r["grams"], np.uint64) for r in rows])
    if rows[0]["x"] != rows[0]["y"]:
        side = np.array([r["side"] for r in rows])
        i, j = i[side[i] != side[j]], j[side[i] != side[j]]
    met = np.array([r["met"] for r in rows], np.int64)[:, : rows[0]["run"]]
    new = ~((met[i] == met[j]) & (met[i] != 0)).any(axis=1)
    i, j = i[new], j[new]
    if not len(i):
        return []
    copies = np.array([r["copies"] for r in rows])
    links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    root, before = np.arange(len(rows)), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        root = root[root]
    return [(rows[k]["set"], int(links[k]), rows[root[k]]["set"]) for k in np.flatnonzero(links)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squares arrive one after the other; a square has at most 2 * ``LEAF`` sets on average."""
    key, rows, out = None, [], []

    def answer(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.binary(), pa.int64(), pa.binary()], strict=True)], ["set", "links", "root"])

    for batch in batches:
        for row in batch.to_pylist():
            this = (row["node"], row["run"], row["x"], row["y"])
            if this != key and rows:
                out += _compare_square(rows)
                rows = []
            key = this
            rows.append(row)
        if len(out) > 20_000:
            yield answer(out)
            out = []
    if rows:
        out += _compare_square(rows)
    yield answer(out)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """One row for each document: ``doc_id, class_id`` (least doc_id of its class), ``n_links`` (similar documents besides
    itself), ``_print`` (hash of the text) and ``first`` (whether the row is the one of its class to keep)."""
    p, q = LIKE
    runs = runs_for(recall, p / q, DEPTH)
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    keyed = docs.select(key.alias("_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_print"), "text")
    signed = stored(keyed.mapInArrow(_sign(runs * DEPTH), "_key long, _print long, set binary, size long, tokens array<long>"), "signatures")
    grouped = signed.filter("set is not null").groupBy("set").agg(
        F.min(F.struct("_key", "_print")).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("tokens").alias("tokens")
    )
    sets = stored(grouped, "gram-sets")

    rows = with_news(leaves(sets.select("set", "size", "tokens"), runs, leaf), runs, leaf)
    wanted = rows.groupBy("set").agg(F.collect_list(F.struct("node", "run", "n")).alias("leaves"), F.first("met").alias("met"))
    wanted = wanted.join(sets.select("set", "rep", "copies"), "set")
    # the text of a set comes from one row's doc_id and text together: rows without an id share the former
    named = wanted.select("*", "rep.*").drop("rep")
    sent = keyed.join(named, ["_key", "_print"]).select("text", "set", "copies", "met", "leaves").mapInArrow(_send(leaf), SQUARE)
    squares = ["node", "run", "x", "y"]
    dealt = sent.repartition(partitions(docs.sparkSession), *squares).sortWithinPartitions(*squares)
    found = stored(dealt.mapInArrow(_compare, FOUND), "links")

    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("set").alias("a"), F.col("root").alias("b")))
    known = sets.select("set", "rep", "copies").join(links, "set", "left").join(roots.withColumnRenamed("node", "set"), "set", "left")
    known = stored(known.select("set", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set").alias("root")), "sets-known")
    classes = stored(known.groupBy("root").agg(F.min("rep._key").alias("class_id")), "classes")
    classed = known.join(classes, "root").select("set", "copies", "links", "root", "class_id")
    members = signed.select("_key", "_print", "set").join(stored(classed, "sets-classed"), "set", "left")
    best = members.filter("set is not null").groupBy("root").agg(F.min(F.struct("_key", "_print")).alias("_best"))
    members = members.join(stored(best, "class-firsts"), "root", "left")
    shown = lambda c: F.when(c != NO_ID, c)
    return members.select(
        shown(F.col("_key")).alias("doc_id"),
        shown(F.coalesce("class_id", "_key")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        "_print",
        (F.col("set").isNull() | (F.struct("_key", "_print") == F.col("_best"))).alias("first"),
    )
