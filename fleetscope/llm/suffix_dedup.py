"""Removal of passages that an earlier document holds, from suffix order.

A byte goes when a string of ``SPAN`` bytes over it also starts in a document with a smaller doc_id. For each place the
longest previous factor tells: of all places of earlier documents, the last before it and the first after it in suffix
order share the longest prefixes with it (previous and next smaller values over the documents in suffix order, with the least
of the shared lengths between). Factors of ``SPAN`` bytes or more are earlier matches.

A suffix array of everything doesn't fit one task, so places are dealt out by content first. Every ``SPAN``-byte window picks
the least hash among its ``GRAM``-byte grams; neighbouring windows with one pick form a fragment (about 16 windows). Equal
windows pick alike, so all copies of a window meet where their pick goes:

1. documents are packed into blocks of about ``BLOCK`` bytes, stored once in the shared folder;
2. blocks send the picks they hold, once each, to buckets, which answer which picks occur in two documents at least;
3. blocks send the fragments of those picks, equal ones once; each bucket sorts the suffixes of its fragments, takes the factors
   and answers the windows whose factor tells of a document earlier than the block knows (a fragment that shares its pick with no
   other fragment has no factor to look for);
4. blocks mark the windows and cut the texts.

Exact copies, frequent lines and common passages are one entry per block and bucket. A pick that more than ``HOT_BLOCKS``
blocks hold (a frequent string in changing surroundings) sends its windows apart, each to the bucket of its own bytes.

Defined results: a null text is empty; a null doc_id is smaller than all others; rows with equal doc_id never remove from
each other; texts below ``SPAN`` bytes keep everything. Only doc_id and text are read. One text must fit into a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import batch_bytes, mix, partitions, sliding_min, stored

SPAN = 50
GRAM = 20
BLOCK = 4 << 20
BUCKET = 12 << 20  # bytes of text for which one bucket is made
RUN = 64  # most windows of a fragment
HOT_BLOCKS = 256
LEVEL = 6
NO_ID = -(1 << 63)
STEP = 1 << 17  # windows hashed at once

BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD1342543DE82EF95)


def _i64(values) -> bytes:
    return np.ascontiguousarray(values, "<i8").tobytes()


def _batch(names: list[str], columns: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


# blocks -----------------------------------------------------------------------------------------------------------


def _pack(block_bytes: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, held = TaskContext.get().partitionId() << 32, 0, 0
        packer = zstandard.ZstdCompressor(level=LEVEL)
        ids: list[int] = []
        sizes: list[int] = []
        parts: list[bytes] = []

        def block() -> pa.RecordBatch:
            row = [[first + n], [_i64(ids)], [_i64(sizes)], [packer.compress(b"".join(parts))], [held]]
            return _batch(["block", "ids", "sizes", "packed", "n_bytes"], row, [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()])

        for batch in batches:
            data, offsets = batch_bytes(batch.column(1))
            names = batch.column(0).fill_null(NO_ID).to_pylist()
            raw = data.tobytes()
            for name, a, b in zip(names, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids.append(name)
                sizes.append(b - a)
                parts.append(raw[a:b])
                held += b - a
                if held >= block_bytes or len(ids) >= 1 << 15:
                    yield block()
                    n, held = n + 1, 0
                    ids, sizes, parts = [], [], []
        if ids:
            yield block()

    return pack


class Block:
    """One block's documents and the fragments in them."""

    def __init__(self, ids: bytes, sizes: bytes, packed: bytes, buckets: int) -> None:
        self.ids = np.frombuffer(ids, "<i8")
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
        self.raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(self.offsets[-1])))
        self.starts, self.counts, picks = runs(np.frombuffer(self.raw, np.uint8), self.offsets)
        self.docs = np.searchsorted(self.offsets, self.starts, "right") - 1
        mixed = mix(picks)
        self.bucket = (mixed >> np.uint64(32)) % np.uint64(buckets)
        self.code = mixed & np.uint64(0xFFFFFFFF)

    def picks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (bucket, code) in order, whether several documents hold each, and the entry of each run."""
        joined = (self.bucket << np.uint64(32)) | self.code
        order = np.argsort(joined, kind="stable")
        ordered, ids = joined[order], self.ids[self.docs[order]]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
        entry = np.cumsum(new) - 1
        several = np.zeros(int(new.sum()), bool)
        if len(ordered):
            several[entry[1:][~new[1:] & (ids[1:] != ids[:-1])]] = True
        which = np.empty(len(order), np.int64)
        which[order] = entry
        return ordered[new], several, which


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and pick of each run of windows with one pick; none crosses a document's end."""
    ends = np.maximum(offsets[1:] - (SPAN - 1), offsets[:-1])
    forced = np.unique(np.concatenate([offsets[:-1], ends]))
    total = len(data) - SPAN + 1
    bounds, picks, before = [], [], None
    powers = [BASE]
    with np.errstate(over="ignore"):
        for _ in range(3):
            powers.append(powers[-1] * powers[-1])
        for a in range(0, max(0, total), STEP):
            b = min(total, a + STEP)
            h = h4 = BYTE_HASH[data[a : b + SPAN - 1]]
            for n, p in enumerate(powers):
                h = h[: -(1 << n)] * p + h[1 << n :]
                h4 = h if n == 1 else h4
            h = h[:-4] * powers[2] + h4[16:]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            least = sliding_min(h, SPAN - GRAM + 1)
            changed = np.concatenate([[before is None or least[0] != before], least[1:] != least[:-1]])
            own = forced[np.searchsorted(forced, a) : np.searchsorted(forced, b)] - a
            changed[own] = True
            at = np.flatnonzero(changed)
            bounds.append(at + a)
            picks.append(least[at])
            before = least[-1]
    if not bounds:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, picks = np.concatenate(bounds), np.concatenate(picks)
    counts = np.diff(np.concatenate([starts, [total]]))
    doc = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + SPAN <= offsets[doc + 1]
    starts, counts, picks = starts[inside], counts[inside], picks[inside]
    if (counts > RUN).any():
        pieces = -(-counts // RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, rest, picks = np.repeat(starts, pieces) + nth * RUN, np.repeat(counts, pieces) - nth * RUN, np.repeat(picks, pieces)
        counts = np.minimum(rest, RUN)
    return starts, counts, picks


# picks ------------------------------------------------------------------------------------------------------------


def _send_picks(buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            joined, several, _ = Block(row["ids"], row["sizes"], row["packed"], buckets).picks()
            names = (joined >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else []
            out: list[list] = [[], [], [], []]
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                values = [int(names[a]), row["block"], joined[a:b].astype("<u4").tobytes(), np.packbits(several[a:b]).tobytes()]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield _batch(["bucket", "block", "codes", "several"], out, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return send


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _answer_picks(hot_blocks: int) -> Callable:
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        codes = [np.frombuffer(r["codes"], "<u4") for r in rows]
        several = np.concatenate([_bits(r["several"], len(c)) for r, c in zip(rows, codes, strict=True)])
        _, which, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        twice = counts > 1
        twice[which[several]] = True
        cuts = np.cumsum([len(c) for c in codes])[:-1]
        out: list[list] = [[], [], [], []]
        for r, mine in zip(rows, np.split(which, cuts), strict=True):
            if twice[mine].any():
                values = [r["bucket"], r["block"], np.packbits(twice[mine]).tobytes(), np.packbits(counts[mine] > hot_blocks).tobytes()]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
        return pa.table([pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["bucket", "block", "twice", "hot"])

    return answer


# fragments --------------------------------------------------------------------------------------------------------


class Fragments:
    """Distinct fragments of a block that other documents may hold, in order of their buckets; and where they are."""

    def __init__(self, block: Block, answers: list[dict], buckets: int) -> None:
        joined, _, which = block.picks()
        twice, hot = np.zeros(len(joined), bool), np.zeros(len(joined), bool)
        names = joined >> np.uint64(32)
        for r in answers:
            a, b = np.searchsorted(names, np.uint64(r["bucket"])), np.searchsorted(names, np.uint64(r["bucket"]), "right")
            twice[a:b], hot[a:b] = _bits(r["twice"], b - a), _bits(r["hot"], b - a)
        plain, apart = np.flatnonzero((twice & ~hot)[which]), np.flatnonzero((twice & hot)[which])
        counts = block.counts[apart]
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.starts = np.concatenate([block.starts[plain], np.repeat(block.starts[apart], counts) + nth])
        self.counts = np.concatenate([block.counts[plain], np.ones(counts.sum(), np.int64)])
        self.docs = np.concatenate([block.docs[plain], np.repeat(block.docs[apart], counts)])
        seen: dict[bytes, int] = {}
        raw = block.raw
        places = zip(self.starts.tolist(), (self.starts + self.counts + SPAN - 1).tolist(), strict=True)
        self.of = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in places), np.int64, len(self.starts))
        self.texts = list(seen)
        bucket, code = np.empty(len(seen), np.int64), np.empty(len(seen), np.uint32)
        bucket[self.of[: len(plain)]], code[self.of[: len(plain)]] = block.bucket[plain].astype(np.int64), block.code[plain]
        if len(apart):
            for i in np.unique(self.of[len(plain) :]):
                own = xxhash.xxh3_64_intdigest(self.texts[i])
                bucket[i], code[i] = (own >> 32) % buckets, own & 0xFFFFFFFF
        self.first = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.of, block.ids[self.docs])
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of, self.first, self.bucket, self.code = rank[self.of], self.first[order], bucket[order], code[order]
        self.texts = [self.texts[i] for i in order]


def _send_fragments(buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for row in _rows(batches):
            own = Fragments(Block(row["ids"], row["sizes"], row["packed"], buckets), row["answers"], buckets)
            if not own.texts:
                continue
            cuts = np.flatnonzero(np.concatenate([[True], own.bucket[1:] != own.bucket[:-1]])).tolist()
            out: list[list] = [[], [], [], [], []]
            for a, b in zip(cuts, [*cuts[1:], len(own.texts)], strict=True):
                lengths = np.fromiter(map(len, own.texts[a:b]), np.uint8, b - a)
                values = [int(own.bucket[a]), row["block"], pack.compress(b"".join(own.texts[a:b])), lengths.tobytes() + own.code[a:b].astype("<u4").tobytes(), pack.compress(_i64(own.first[a:b]))]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield _batch(["bucket", "block", "texts", "marks", "firsts"], out, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    return send


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``SPAN`` bytes of all texts: their order, the bytes each shares with the one before it in that order
    (0 for the first), and how many each text has. A suffix ends with its text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts, width = lengths - SPAN + 1, int(lengths.max())
    data = np.frombuffer(b"".join(t + bytes(width) for t in texts), np.uint8)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[np.repeat(np.cumsum(lengths + width) - lengths - width, counts) + nth]
    left = np.repeat(lengths, counts) - nth
    order = np.lexsort((left, np.ascontiguousarray(rows).view(f"S{width}").ravel()))  # zero bytes at the end don't count as more text
    rows, left = rows[order], left[order]
    other = rows[1:] != rows[:-1]
    same = np.where(other.any(axis=1), other.argmax(axis=1), width)
    shared = np.minimum(same, np.minimum(left[1:], left[:-1]))
    return order, np.concatenate([[0], shared])[: len(order)], counts


def nearest_smaller(docs: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the order the last place before it with a smaller document (-1: none), and the bytes shared with it.

    Places point to their neighbour at first. One that points to no smaller document takes over that one's pointer, since
    all between are no smaller either; so pointers reach twice as far each round.
    """
    to, bytes_ = np.arange(len(docs)) - 1, shared.copy()
    going = np.arange(len(docs))
    while len(going):
        going = going[(to[going] >= 0) & (docs[to[going]] >= docs[going])]
        over = to[going]
        to[going], bytes_[going] = to[over], np.minimum(bytes_[going], bytes_[over])
    return to, np.where(to < 0, 0, bytes_)


def previous_factors(texts: list[bytes], firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest previous factor of each suffix (text by text): its bytes and the earlier document that holds it; and suffixes a text.

    The previous and the next smaller document in suffix order are the earlier ones that share most with a suffix.
    """
    order, shared, counts = suffix_order(texts)
    docs = np.repeat(firsts, counts)[order]
    before, left = nearest_smaller(docs, shared)
    after, right = nearest_smaller(docs[::-1], np.concatenate([[0], shared[:0:-1]])[: len(docs)])
    after, right = np.where(after < 0, -1, len(docs) - 1 - after)[::-1], right[::-1]
    longest, holder = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64)
    near = np.where(left >= right, before, after)
    longest[order] = np.maximum(left, right)
    holder[order] = np.where(near < 0, docs, docs[near])
    return longest, holder, counts


def earlier_documents(texts: list[bytes], firsts: np.ndarray) -> list[np.ndarray]:
    """For each window of each fragment an earlier document that holds it, by factors of ``SPAN`` bytes or more; else its own."""
    longest, holder, counts = previous_factors(texts, firsts)
    docs = np.where(longest >= SPAN, holder, np.repeat(firsts, counts))
    return np.split(docs, np.cumsum(counts)[:-1])


def _answer_fragments(table: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor()
    known: dict[bytes, int] = {}
    rows, firsts, codes = [], [], []
    for r in table.to_pylist():
        n = len(r["marks"]) // 5
        lengths, code = np.frombuffer(r["marks"], np.uint8, n), np.frombuffer(r["marks"], "<u4", offset=n)
        first = np.frombuffer(unpack.decompress(r["firsts"]), "<i8")
        data, ends = unpack.decompress(r["texts"]), np.cumsum(lengths, dtype=np.int64)
        which = np.fromiter((known.setdefault(data[e - k : e], len(known)) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)), np.int64, n)
        rows.append((r["block"], which, first))
        firsts.append(first)
        codes.append(code)
    texts = list(known)
    all_which = np.concatenate([w for _, w, _ in rows])
    first = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(first, all_which, np.concatenate(firsts))
    code = np.empty(len(texts), np.uint32)
    code[all_which] = np.concatenate(codes)
    _, group, sizes = np.unique(code, return_inverse=True, return_counts=True)
    several = np.flatnonzero(sizes[group] > 1)
    order = several[np.argsort(group[several], kind="stable")]
    windows: dict[int, np.ndarray] = {}
    cuts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])).tolist() if len(order) else []
    start = 0
    for cut in [*cuts[1:], len(order)] if cuts else []:  # whole groups, about 10,000 fragments at a time
        if cut - start >= 10_000 or cut == len(order):
            some = order[start:cut].tolist()
            windows.update(zip(some, earlier_documents([texts[i] for i in some], first[some]), strict=True))
            start = cut
    changes = {}
    for i, docs in windows.items():
        at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        changes[i] = (at, np.concatenate([at[1:], [len(docs)]]), docs[at])
    out: list[list] = [[], [], []]
    for block, which, own in rows:
        plain = np.flatnonzero((first[which] < own) & (sizes[group[which]] == 1))
        parts = [np.stack([plain, np.zeros_like(plain), np.fromiter((len(texts[i]) - SPAN + 1 for i in which[plain]), np.int64, len(plain)), first[which[plain]]])]
        for n in np.flatnonzero(sizes[group[which]] > 1).tolist():
            a, b, docs = changes[int(which[n])]
            earlier = docs < own[n]
            if earlier.any():
                parts.append(np.stack([np.full(int(earlier.sum()), n), a[earlier], b[earlier], docs[earlier]]))
        found = np.concatenate(parts, axis=1)
        if found.shape[1]:
            for column, value in zip(out, [table["bucket"][0].as_py(), block, zstandard.compress(_i64(found), 3)], strict=True):
                column.append(value)
    return pa.table([pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["bucket", "block", "found"])


# cutting ----------------------------------------------------------------------------------------------------------


def _cut(buckets: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for row in _rows(batches):
            block = Block(row["ids"], row["sizes"], row["packed"], buckets)
            own = Fragments(block, row["answers"] or [], buckets)
            depth = np.zeros(len(block.raw) + 1, np.int32)
            ids = block.ids[own.docs]

            def mark(starts: np.ndarray, ends: np.ndarray, depth=depth) -> None:
                np.add.at(depth, starts, 1)
                np.add.at(depth, ends, -1)

            within = own.first[own.of] < ids
            mark(own.starts[within], (own.starts + own.counts + SPAN - 1)[within])
            order = np.argsort(own.of, kind="stable")
            ordered = own.of[order]
            for r in row["found"] or []:
                n, a, b, first = np.frombuffer(unpack.decompress(r["found"]), "<i8").reshape(4, -1)
                n = n + np.searchsorted(own.bucket, r["bucket"])
                lo, hi = np.searchsorted(ordered, n), np.searchsorted(ordered, n, "right")
                times = hi - lo
                at = order[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                a, b, first = np.repeat(a, times), np.repeat(b, times), np.repeat(first, times)
                ok = first < ids[at]
                mark((own.starts[at] + a)[ok], (own.starts[at] + b + SPAN - 1)[ok])
            gone = np.cumsum(depth[:-1]) > 0
            data = np.frombuffer(block.raw, np.uint8)
            names, kept, starts, lengths, counts = [], [], [], [], []
            for name, x, y in zip(block.ids.tolist(), block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
                mine = gone[x:y]
                names.append(None if name == NO_ID else name)
                kept.append(data[x:y][~mine].tobytes() if mine.any() else block.raw[x:y])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                starts.append(edges[::2])
                lengths.append(edges[1::2] - edges[::2])
                counts.append(len(edges) // 2)
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(lengths), pa.int64())], ["start", "bytes"])
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans)
            sizes = pa.array(np.diff(block.offsets), pa.int64())
            for i in range(0, len(names), 1000):  # modest batches towards the JVM
                part = slice(i, i + 1000)
                columns = [pa.array(names[part], pa.int64()), sizes[part], pa.array(kept[part], pa.binary()), listed[part]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "kept", "removed"])

    return cut


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", block_bytes: int = BLOCK, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """``doc_id, n_bytes, kept`` (the remaining bytes) and ``removed`` (spans ``start, bytes`` of what was cut)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    blocks = stored(rows.mapInArrow(_pack(block_bytes), "block long, ids binary, sizes binary, packed binary, n_bytes long"), "text-blocks")
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(2 * partitions(spark), size // BUCKET)
    documents = blocks.drop("n_bytes")

    picks = documents.mapInArrow(_send_picks(buckets), "bucket long, block long, codes binary, several binary")
    answers = picks.groupBy("bucket").applyInArrow(_answer_picks(hot_blocks), "bucket long, block long, twice binary, hot binary")
    answers = stored(answers, "repeated-picks").groupBy("block").agg(F.collect_list(F.struct("bucket", "twice", "hot")).alias("answers"))
    fragments = documents.join(answers, "block").mapInArrow(_send_fragments(buckets), "bucket long, block long, texts binary, marks binary, firsts binary")
    found = fragments.groupBy("bucket").applyInArrow(_answer_fragments, "bucket long, block long, found binary")
    found = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("found"))
    known = answers.join(found, "block", "left")
    return documents.join(known, "block", "left").mapInArrow(_cut(buckets), "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,bytes:long>>")
