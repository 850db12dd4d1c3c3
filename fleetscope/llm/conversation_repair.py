"""Repair of conversations to ``(system? (user assistant)+)?`` at the least cost, by the auction algorithm for shortest paths.

A conversation's rows, in order, are the layers of a lattice whose nodes are what the repaired text ends with so far: nothing, a
system, a user or an assistant turn. Arcs are edits: keep a row (0), give it the role user or assistant (1), delete it (2, a must
for blank and repeated rows), insert an empty user or assistant turn (5); a truncated row that stays costs 5 more. The auction
keeps a price for each node, never above an arc's cost plus the price of its head. A path grows from the origin along arcs
whose bound is met; where none is, the last node's price rises to the least bound and the path steps back. When it
arrives, the origin's price is the distance, and all cheapest paths run along tight arcs; of those that reach the end the letters
D, I, K, R are taken in ASCII order.

Rows are range-partitioned and sorted by conversation and turn, so a conversation of any size spreads over tasks. Tasks cut
it into blocks of ``BLOCK`` rows. A conversation within one block is done there and then. For the others each block gets
its distances between all entries and exits; a pass over these small rows, last block first, gives the price of every
block's exits; blocks are then traced from each entry side by side, and a last pass in order picks the entries, closes the
counts and the digest (which has to see the turns one after the other, but holds one block at a time).

Defined results: order is by turn (null first), then role, the first 64 characters of the text, and a digest of both. Null roles and
texts are one space. A null conversation id is a conversation. A role's initial is its first character; one that isn't s, u or a
can't stay. Rows equal in role and text to an earlier one of the conversation are duplicates, whatever their turn. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import partitions, stored

BLOCK = 128
SPACE = b" \t\n\r\x0b\x0c"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SOUND, MUST_GO, TRUNCATED = range(3)
#: Cost of ending a conversation in each state: the turns that are still inserted.
AT_END, TAILS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
MEMO = 50_000  # lattices that a worker remembers

Prices = tuple[int | None, ...]

# the lattice ------------------------------------------------------------------------------------------------------


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _arcs(codes: bytes, exits: Prices) -> tuple[list[list[tuple[str, int, int]]], list[int]]:
    """Arcs (letter, head, cost) out of each node, only between nodes that reach the end, and prices no arc undercuts.

    Node ``4 * layer + state``; the last node is the end. A code is the row's initial (s, u, a, other) + 4 * fault.
    """
    n, end = len(codes), 4 * len(codes) + 4
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(end + 1)]
    least = min(p for p in exits if p is not None)
    price, reach = [least] * end + [0], [False] * end + [True]
    for state, p in enumerate(exits):
        if p is not None:
            arcs[4 * n + state].append(("", end, p))
            reach[4 * n + state] = True
    for layer in range(n - 1, -1, -1):
        initial, fault = codes[layer] & 3, codes[layer] >> 2
        more = CUT_OFF if fault == TRUNCATED else 0
        least += DELETE if fault else (RENAME if initial == 3 else KEEP)
        for state in range(4):
            node, heads = 4 * layer + state, [("D", state, DELETE)]
            price[node] = least
            if fault != MUST_GO:
                after = _next(state)
                heads.append(("R", after, RENAME + more))
                if (initial, after) in ((1, USER), (2, ASSISTANT)):
                    heads.append(("K", after, KEEP + more))
                elif initial == 0 and state == NOTHING:
                    heads.append(("K", SYSTEM, KEEP + more))
            arcs[node] = [(letter, 4 * layer + 4 + s, c) for letter, s, c in heads if reach[4 * layer + 4 + s]]
            reach[node] = bool(arcs[node])
        for _ in range(2):  # an insert may need another
            for state in range(4):
                if reach[4 * layer + _next(state)]:
                    reach[4 * layer + state] = True
        for state in range(4):
            if reach[4 * layer + _next(state)]:
                arcs[4 * layer + state].append(("I", 4 * layer + _next(state), INSERT))
    return arcs, price


def auction(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int) -> int:
    """Raises prices until the origin's is its distance to the last node, which it returns."""
    path, end = [origin], len(arcs) - 1
    while path[-1] != end:
        node = path[-1]
        bound, head = min((cost + price[head], head) for _, head, cost in arcs[node])
        if price[node] == bound:
            path.append(head)
        else:
            price[node] = bound
            if len(path) > 1:
                path.pop()
    return price[origin]


@lru_cache(MEMO)
def distances(codes: bytes) -> tuple[Prices, ...]:
    """Least cost from each entry state (rows) to each exit state, None if there is no way."""
    out: list[list[int | None]] = [[None] * 4 for _ in range(4)]
    for to in range(4):
        arcs, price = _arcs(codes, tuple(0 if s == to else None for s in range(4)))
        for entry in range(4):
            if arcs[entry]:
                out[entry][to] = auction(arcs, price, entry)
    return tuple(tuple(row) for row in out)


@lru_cache(MEMO)
def cheapest(codes: bytes, exits: Prices, entry: int) -> tuple[str, int, int]:
    """ASCII-least letters of a cheapest way through the rows, the state it ends in, and its cost with the price of that exit."""
    arcs, price = _arcs(codes, exits)
    cost = auction(arcs, price, entry)
    tight = [[(letter, head) for letter, head, c in out if price[node] == c + price[head]] for node, out in enumerate(arcs)]
    ends = [False] * len(arcs)
    ends[-1] = True
    for layer in range(len(codes), -1, -1):
        for _ in range(3):  # inserts lead to nodes of the same layer
            for node in range(4 * layer, 4 * layer + 4):
                ends[node] = ends[node] or any(ends[head] for _, head in tight[node])
    letters, node = [], entry
    while node < 4 * len(codes):
        letter, node = min((letter, head) for letter, head in tight[node] if ends[head])
        letters.append(letter)
    return "".join(letters), node - 4 * len(codes), cost


def through(rows: tuple[Prices, ...], exits: Prices) -> Prices:
    """Prices of a block's entries from its distances and the prices of its exits."""
    options = [[d + p for d, p in zip(row, exits, strict=True) if d is not None and p is not None] for row in rows]
    return tuple(min(o) if o else None for o in options)


# tasks ------------------------------------------------------------------------------------------------------------

BLOCKS = "conv {conv}, pos long, open boolean, turns array<long>, roles array<string>, texts array<string>, faults array<int>, digests array<binary>"
PARTS = (
    "conv {conv}, pos long, blank long, duplicate long, truncated long, illegal long, min_turn long, max_turn long, n_turns long, cost long, "
    "audit string, repaired array<struct<role:string,text:string>>, sha256 string"
)
BLANK, DUPLICATE, CUT = 1, 2, 3


def _schema(template: str, conv: str) -> str:
    return template.format(conv=conv)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _blocks_schema(conv: pa.DataType) -> pa.Schema:
    kinds = [conv, pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary())]
    return pa.schema(list(zip("conv pos open turns roles texts faults digests".split(), kinds, strict=True)))


def _parts_schema(conv: pa.DataType) -> pa.Schema:
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    names = "conv pos blank duplicate truncated illegal min_turn max_turn n_turns cost audit repaired sha256".split()
    return pa.schema(list(zip(names, [conv, *[pa.int64()] * 9, pa.string(), turns, pa.string()], strict=True)))


def _cut(block: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of sorted rows. ``open``: the conversation has, or may have, other blocks."""
        base, count, conversations, out, size = TaskContext.get().partitionId() << 33, 0, 0, [], 0
        conv, seen, held, opened, schema = None, set(), [], False, None

        def flush(last: bool) -> None:
            nonlocal count, held, opened
            opened = opened or last or conversations == 1 or len(held) == block
            turns, roles, texts, faults, digests = zip(*held, strict=True)
            out.append((conv, base + count, opened, turns, roles, texts, faults, digests if opened else None))
            count, held = count + 1, []

        for batch in batches:
            schema = schema or _blocks_schema(batch.schema.field(0).type)
            for own, turn, role, text, digest in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if own != conv or not conversations:
                    if held:
                        flush(False)
                    conv, seen, opened, conversations = own, set(), False, conversations + 1
                elif len(held) == block:
                    flush(False)
                solid = text.encode().rstrip(SPACE)
                fault = BLANK if not solid else DUPLICATE if digest in seen else CUT if solid[-1:] not in (b".", b"!", b"?") else 0
                seen.add(digest)
                held.append((turn, role, text, fault, digest))
                size += len(solid) + 50
            if size > 1 << 23:
                yield _batch(out, schema)
                out, size = [], 0
        if held:
            flush(True)
        if out:
            yield _batch(out, schema)

    return cut


def _codes(roles: list[str], faults: list[int]) -> bytes:
    kinds = (SOUND, MUST_GO, MUST_GO, TRUNCATED)
    return bytes({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * kinds[fault] for role, fault in zip(roles, faults, strict=True))


def repaired_turns(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The turns that the letters leave or make, and the state after them."""
    out, at = [], 0
    for letter in audit:
        after = _next(state)
        name = "user" if after == USER else "assistant"
        if letter == "K":
            out.append((roles[at], texts[at]))
            after = SYSTEM if roles[at][:1] == "s" else after
        elif letter != "D":
            out.append((name, texts[at] if letter == "R" else ""))
        state = state if letter == "D" else after
        at += letter != "I"
    return out, state


class Reader:
    """Reads the blocks of one conversation in order and gives the row of each."""

    def __init__(self) -> None:
        self.state, self.role, self.turn, self.digest, self.empty = NOTHING, None, None, hashlib.sha256(), True

    def part(self, row: dict, letters: str, last: bool) -> tuple:
        roles, texts, faults = row["roles"], row["texts"], row["faults"]
        turns, self.state = repaired_turns(letters, self.state, roles, texts)
        price = {"D": DELETE, "I": INSERT, "K": KEEP, "R": RENAME}
        cost, at = 0, 0
        for letter in letters:
            cost += price[letter] + (CUT_OFF if letter in "KR" and faults[at] == CUT else 0)
            at += letter != "I"
        if last:
            tail = TAILS[self.state]
            more, self.state = repaired_turns(tail, self.state, [], [])
            turns, letters, cost = turns + more, letters + tail, cost + INSERT * len(tail)
        if turns:
            told = "\n".join(f"{role}:{text}" for role, text in turns)
            self.digest.update(told.encode() if self.empty else b"\n" + told.encode())
            self.empty = False
        illegal = 0
        for role in roles:
            illegal += self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au")
            self.role = role
        real = [t for t in row["turns"] if t is not None]
        new = len(set(real)) - (bool(real) and real[0] == self.turn)
        self.turn = real[-1] if real else self.turn
        counts = [sum(f == kind for f in faults) for kind in (BLANK, DUPLICATE, CUT)]
        shown = [{"role": r, "text": t} for r, t in turns]
        ends = (min(real), max(real)) if real else (None, None)
        return (row["conv"], row["pos"], *counts, illegal, *ends, new, cost, letters, shown, self.digest.hexdigest() if last else None)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            letters, _, _ = cheapest(_codes(row["roles"], row["faults"]), AT_END, NOTHING)
            out.append(Reader().part(row, letters, True))
        yield _batch(out, _parts_schema(batch.schema.field("conv").type))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = [[d for row in distances(_codes(r, f)) for d in row] for r, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.int64()))], ["conv", "pos", "distances"])


def _price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prices of each block's exits; blocks of a conversation come last first."""
    conv, prices = (), AT_END
    for batch in batches:
        out = []
        for own, flat in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            last = (own,) != conv
            if last:
                conv, prices = (own,), AT_END
            out.append((prices, last))
            prices = through(tuple(tuple(flat[4 * s : 4 * s + 4]) for s in range(4)), prices)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([p for p, _ in out], pa.list_(pa.int64())), pa.array([x for _, x in out])], ["pos", "exits", "last"])


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cheapest letters through each block from every entry state that has a way."""
    for batch in batches:
        ways = []
        for roles, faults, exits in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("roles", "faults", "exits")), strict=True):
            codes = _codes(roles, faults)
            open_ways = through(distances(codes), tuple(exits))
            ways.append([None if way is None else cheapest(codes, tuple(exits), entry)[0] for entry, way in enumerate(open_ways)])
        yield batch.append_column("ways", pa.array(ways, pa.list_(pa.string())))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks that come in order."""
    reader = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            reader = reader or Reader()
            out.append(reader.part(row, row["ways"][reader.state], row["last"]))
            if row["last"]:
                reader = None
        yield _batch(out, _parts_schema(batch.schema.field("conv").type))


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each block of a conversation: ``conv, pos`` (order), counts of ``blank, duplicate, truncated, illegal`` rows, ``min_turn,
    max_turn, n_turns`` (turns not met in earlier blocks), ``cost``, ``audit`` (letters), ``repaired`` (turns as structs) and, in the last
    block, ``sha256`` of all repaired turns as ``role:text`` lines."""
    n, kind = partitions(rows.sparkSession), rows.schema[conv].dataType.simpleString()
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    digest = F.unhex(F.md5(F.concat("role", F.lit("\x01"), "text")))
    own = own.select("*", digest.alias("digest"), F.substring("text", 1, 64).alias("_head"), F.monotonically_increasing_id().alias("_row"))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "_head", "digest", "_row"]
    ordered = own.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "digest")
    blocks = stored(ordered.mapInArrow(_cut(block), _schema(BLOCKS, kind)), "blocks")
    whole = blocks.filter(~F.col("open")).mapInArrow(_whole, _schema(PARTS, kind))
    apart = blocks.filter("open")

    # rows that repeat one of an earlier block
    entries = apart.select("conv", "pos", F.posexplode("digests").alias("at", "digest"))
    firsts = entries.groupBy(F.col("conv").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min("pos").alias("_first"))
    again = entries.join(firsts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))).filter("pos > _first")
    again = again.groupBy("pos").agg(F.collect_set("at").alias("again"))
    repeated = lambda f, i: F.when((f != BLANK) & F.array_contains("again", i), DUPLICATE).otherwise(f)
    apart = apart.drop("digests", "open").join(again, "pos", "left")
    apart = stored(apart.withColumn("faults", F.when(F.col("again").isNull(), F.col("faults")).otherwise(F.transform("faults", repeated))).drop("again"), "open-blocks")

    measured = apart.select("conv", "pos", "roles", "faults").mapInArrow(_measure, f"conv {kind}, pos long, distances array<long>")
    backwards = measured.repartition(n, "conv").sortWithinPartitions("conv", F.desc("pos"))
    prices = backwards.mapInArrow(_price, "pos long, exits array<long>, last boolean")
    columns = _schema(BLOCKS.replace(", open boolean", "").replace(", digests array<binary>", ""), kind)
    priced = apart.select("conv", "pos", "turns", "roles", "texts", "faults").join(prices, "pos").select("conv", "pos", "turns", "roles", "texts", "faults", "exits", "last")
    traced = priced.mapInArrow(_trace, f"{columns}, exits array<long>, last boolean, ways array<string>").drop("exits")
    walked = traced.repartition(n, "conv").sortWithinPartitions("conv", "pos").mapInArrow(_walk, _schema(PARTS, kind))
    return whole.unionByName(walked)


def summed(parts: DataFrame) -> DataFrame:
    """The parts of each conversation as one row: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256``."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "audit"))), lambda p: p["audit"]), "")
    gaps = F.coalesce(F.max("max_turn") - F.min("min_turn") + 1 - F.sum("n_turns"), F.lit(0))
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return parts.groupBy("conv").agg(gaps.alias("gaps"), *counts, letters.alias("audit"), F.max("sha256").alias("sha256"))
