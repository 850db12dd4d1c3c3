"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower case. Of every ``WINDOW - GRAM + 1`` neighbouring
word ``GRAM``-grams the one with the least hash is kept (all of them at a tie), on both sides alike. Two texts that share
``WINDOW`` words therefore share a kept gram at the same place of the shared words, so none is missed. Grams join documents
to benchmark items, and each hit is extended word by word, with the words themselves compared; only spans of ``WINDOW``
words or more count. An item of fewer words is one span of its own length, found by the hash of the whole item.

Before grams leave a task they are held against a filter of ``FILTER_BITS`` bits over the benchmark's grams (128 KB at any
benchmark size; false alarms only cost time). The join then decides by size whether the benchmark is broadcast.

Defined results: null and wordless texts have no words, are hit nowhere and hit nothing. Items with equal item_id count once,
a null item_id counts as item ``null``. Documents with equal or null doc_id are still judged one by one. An empty
benchmark hits nothing. Columns of the input are kept, except those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import HASHES, batch_bytes, gram_hashes, sliding_min

WINDOW = 13
GRAM = 5
FILTER_BITS = 1 << 20
SLICE_BYTES = 1 << 20  # text whose words are in memory at once; a longer text is a slice of its own
NO_ID = -(1 << 63)

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
TABLE = bytes(c if c in _KEEP else ord(chr(c).lower()) if 65 <= c <= 90 else 32 for c in range(256))

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
NAMES = ["n_words", "n_hit", "items", "spans"]
OWN = ["_key", "_print"]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def count_words(text: bytes) -> int:
    solid = np.frombuffer(text.translate(TABLE), np.uint8) != 32
    return int(solid[:1].sum()) + int(np.count_nonzero(solid[1:] & ~solid[:-1]))


def kept_grams(hashes: np.ndarray, lengths: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Kept grams of texts that lie one after the other, and the text of each.

    ``short``: lengths of short items; all grams of these lengths are kept too.
    """
    owner = np.repeat(np.arange(len(lengths)), lengths)
    values, owners = [], []
    grams = gram_hashes(hashes, GRAM)
    span = WINDOW - GRAM + 1
    if len(hashes) >= WINDOW:
        least = sliding_min(grams, span)
        whole = owner[: len(least)] == owner[WINDOW - 1 :]
        kept = np.zeros(len(grams), bool)
        for shift in range(span):
            kept[shift : shift + len(least)] |= whole & (grams[shift : shift + len(least)] == least)
        values.append(grams[kept])
        owners.append(owner[: len(grams)][kept])
    for n in short:
        if len(hashes) >= n:
            whole = owner[: len(hashes) - n + 1] == owner[n - 1 :]
            values.append(gram_hashes(hashes, n)[whole] ^ np.uint64(n))
            owners.append(owner[: len(whole)][whole])
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(owners)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges (start, end) of neighbouring rows whose sizes sum to ``most`` at the most, or of one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


def _texts(column: pa.Array) -> list[bytes]:
    data, offsets = batch_bytes(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
            words = words_of(text)
            n = len(words)
            short = (n,) if 0 < n < WINDOW else ()
            grams = np.unique(kept_grams(HASHES.of(words), np.array([n]), short)[0]).view(np.int64)
            length = pa.array(np.full(len(grams), n if short else 0, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(grams), pa.string()), pa.array(grams), length], ["item", "gram", "short"])


def _document_grams(filter_bits: bytes, short: tuple[int, ...]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(filter_bits, np.uint8)).astype(bool)
        for batch in batches:
            for start, end in slices(np.diff(batch_bytes(batch.column(2))[1]), SLICE_BYTES):
                part = batch.slice(start, end - start)
                keys, prints = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                by_text = [words_of(t) for t in _texts(part.column(2))]
                hashes = HASHES.of([w for ws in by_text for w in ws])
                grams, owners = kept_grams(hashes, np.array([len(ws) for ws in by_text], np.int64), short)
                hit = wanted[(grams & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
                rows = np.unique(np.rec.fromarrays([keys[owners[hit]], prints[owners[hit]], grams[hit].view(np.int64)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[f]), pa.int64()) for f in ("f0", "f1", "f2")], [*OWN, "gram"])

    return find


def _extended(doc: np.ndarray, item: np.ndarray, hits: tuple[np.ndarray, np.ndarray], length: int, least: int) -> np.ndarray:
    """Spans (start, end) of the document around the hits that equal the item over ``least`` words or more."""
    at, of = hits
    ok = np.ones(len(at), bool)
    for s in range(length):
        ok &= doc[at + s] == item[of + s]
    at, of = at[ok], of[ok]
    reach = []
    for step, start in ((-1, -1), (1, length)):
        far, alive = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(alive):
            x, y = at[alive] + start + step * far[alive], of[alive] + start + step * far[alive]
            inside = (x >= 0) & (y >= 0) & (x < len(doc)) & (y < len(item))
            alive, x, y = alive[inside], x[inside], y[inside]
            alive = alive[doc[x] == item[y]]
            far[alive] += 1
        reach.append(far)
    spans = np.stack([at - reach[0], at + length + reach[1]], axis=1)
    return np.unique(spans[spans[:, 1] - spans[:, 0] >= least], axis=0)


def item_spans(words: list[bytes], items: list[tuple[str, bytes]]) -> tuple[list[str], np.ndarray]:
    """Items that occur in a document of ``words``, and the spans they hit."""
    ids: dict[bytes, int] = {}
    doc = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    hashes = HASHES.of(words)
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found, spans = set(), []
    for name, text in items:
        own = words_of(text)
        n = min(len(own), WINDOW)
        length = GRAM if n == WINDOW else n
        if not 0 < n <= len(words):
            continue
        if length not in by_length:
            grams = gram_hashes(hashes, length)
            order = np.argsort(grams, kind="stable")
            by_length[length] = grams[order], order
        grams, order = by_length[length]
        item = np.fromiter((ids.get(w, -1) for w in own), np.int64, len(own))
        theirs = gram_hashes(HASHES.of(own), length)
        if n == WINDOW:
            places = np.flatnonzero(np.isin(theirs, kept_grams(HASHES.of(own), np.array([len(own)]))[0]))
        else:
            places = np.zeros(1, np.int64)
        first, last = np.searchsorted(grams, theirs[places]), np.searchsorted(grams, theirs[places], "right")
        counts = last - first
        at = order[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        here = _extended(doc, item, (at, np.repeat(places, counts)), length, n)
        if len(here):
            found.add(name)
            spans.append(here)
    return sorted(found), np.unique(np.concatenate(spans), axis=0) if spans else np.zeros((0, 2), np.int64)


def _union(spans: np.ndarray, n: int) -> np.ndarray:
    """Disjoint spans of the words that any span covers."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, spans[:, 0], 1)
    np.add.at(depth, spans[:, 1], -1)
    inside = np.concatenate([[False], np.cumsum(depth)[:n] > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges.reshape(-1, 2)


def _judge(text: pa.Array, items: pa.Array) -> pa.Array:
    counts, hits, names, spans = [], [], [], []
    for t, listed in zip(_texts(text), items, strict=True):
        if not listed.is_valid:
            counts.append(count_words(t))
            hits.append(0)
            names.append([])
            spans.append([])
            continue
        words = words_of(t)
        found, where = item_spans(words, [(x["item"], (x["text"] or "").encode()) for x in listed.as_py()])
        where = _union(where, len(words))
        counts.append(len(words))
        hits.append(int((where[:, 1] - where[:, 0]).sum()))
        names.append(found)
        spans.append([{"start": int(a), "end": int(b)} for a, b in where])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip((counts, hits, names, spans), kinds, strict=True)], NAMES)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside occurrences), ``items`` (that occur) and ``spans`` (of hit words)."""
    docs = docs.drop(*NAMES)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    grams = items.mapInArrow(_item_grams, "item string, gram long, short int")
    bits = np.zeros(FILTER_BITS, bool)
    slots = grams.select(F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot"), "short").distinct()
    facts = slots.agg(F.collect_set("slot").alias("slots"), F.collect_set("short").alias("short")).first()  # FILTER_BITS and 13 entries at most
    bits[np.array(facts["slots"], np.int64)] = True
    short = tuple(sorted(set(facts["short"]) - {0}))

    # rows are told apart by doc_id and text, so that many without an id, or with one, don't share each other's items
    own = {"_key": F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)), "_print": F.xxhash64(F.coalesce("text", F.lit("")))}
    found = docs.select(*[c.alias(n) for n, c in own.items()], "text").mapInArrow(_document_grams(np.packbits(bits).tobytes(), short), "_key long, _print long, gram long")
    pairs = found.join(grams.select("gram", "item"), "gram").select(*OWN, "item").distinct()
    listed = pairs.join(items, "item").groupBy(*OWN).agg(F.collect_list(F.struct("item", "text")).alias("_items"))
    joined = docs.withColumns(own).join(listed, OWN, "left")
    return joined.select(*docs.columns, F.arrow_udf(_judge, RESULT)("text", "_items").alias("_judged")).select(*docs.columns, "_judged.*")
