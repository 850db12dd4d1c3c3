"""Language-model scoring by a hidden Markov model over the words of a corpus.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and every text ends with one end token. The states emit symbols: a word that
makes up ``1 / FREQUENT`` of the training tokens or more is a symbol of its own (there can't be more than ``FREQUENT`` of them),
the end token too; every other word, known or not, is emitted as its class (one of ``CLASSES``, by the word's ending) times its
share of the class, which all training words count into. All symbols and shares sum to one in every state.

Passes over the data:

1. Texts become chunks: token numbers over a dictionary of the chunk's own words. (chunk, word) pairs are far fewer than tokens.
2. Pairs are summed to the counts of all words; each chunk gets the counts of its words back, so nothing of the vocabulary's
   size is ever in one place. Chunks then become symbols per document, stored; known and base figures fall out here.
3. Baum-Welch: each task runs scaled forward and backward recursions over many documents in step and sends expected counts
   per symbol (``FREQUENT + CLASSES + 1`` rows of ``STATES`` numbers at most); Spark sums them, the driver normalises. The plan
   (``ROUNDS``) starts on a part of the documents that grows with the corpus and ends on all of them.
4. The scaled forward recursion gives each text's likelihood, over the whole text whatever its length.

In training alone, texts are cut into segments of ``SEGMENT`` tokens, so that a long text doesn't hold a task's memory; segments
after the first start from the states' shares. Words are told apart by 64-bit hashes.

Defined results: a null or wordless text is its end token. A null doc_id counts as the empty text in the choice of training
documents. Rows with equal doc_id are scored one by one and all of them count. With no training documents the base score is 0
and the model is uniform over its symbols. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import batch_bytes, mix, partitions, stored

STATES = 8
FREQUENT = 8192
CLASSES = 2048
SEGMENT = 512
CHUNK = 4_000_000  # tokens of a chunk, about
SLICE = 1 << 22  # bytes of a text that are split into words at once
PARTS = 16
#: (sixteenths of the training documents, rounds over them)
ROUNDS = ((1, 6), (4, 3), (16, 2))
#: Pseudo-counts of a state's emissions, spread by the corpus counts of the symbols, and of its transitions.
EMISSION_PRIOR, MOVE_PRIOR = 50.0, 1.0

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = b" \t\n\r\x0b\x0c"

CHUNKS = "chunk long, keys array<long>, counts array<long>, classes array<int>, body binary"
BODY = pa.schema([("ids", pa.int64()), ("train", pa.bool_()), ("lengths", pa.int64())])
CODED = "doc_id long, train boolean, part int, n_tokens long, n_known long, base_score double, within double, symbols binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Words(dict):
    """Number of each word of a chunk, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in slices that end at white space."""
    start = 0
    while len(text) - start > SLICE:
        ends = [p for p in (text.find(bytes([c]), start + SLICE) for c in SPACE) if p >= 0]
        if not ends:
            break
        yield text[start : min(ends)]
        start = min(ends)
    yield text[start:] if start else text


def word_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % CLASSES


def packed(ids: list, train: list, lengths: list, classes: np.ndarray, tokens: np.ndarray) -> bytes:
    """The documents of a chunk in one value: a column of lists would be sized anew for each row on its way to Python."""
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, BODY.with_metadata({"classes": pack(classes), "tokens": pack(tokens)})) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, train, lengths), BODY.types, strict=True)], schema=BODY))
        return out.getvalue().to_pybytes()


def unpacked(body: bytes) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, whether they teach, their lengths, the classes of the chunk's words, and the tokens."""
    stream = pa.ipc.open_stream(body)
    table, more = stream.read_all().combine_chunks(), stream.schema.metadata
    ids, train, lengths = (table[c].combine_chunks() for c in BODY.names)
    return ids, train, lengths.to_numpy(), unpack(more[b"classes"]), unpack(more[b"tokens"])


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    names = [part.split()[0] for part in CHUNKS.split(", ")]
    first, done = TaskContext.get().partitionId() << 32, 0

    def record(words: Words, ids: list, train: list, lengths: list, tokens: list) -> pa.RecordBatch:
        flat = np.concatenate([*tokens, np.zeros(0, np.int32)])
        counts = np.bincount(flat[np.repeat(np.array(train, bool), lengths)], minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
        classes = np.fromiter(map(word_class, words), np.int32, len(words))
        row = [first + done, keys, counts.astype(np.int64), classes, packed(ids, train, lengths, classes, flat)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    words, ids, train, lengths, tokens, size = Words(), [], [], [], [], 0
    for batch in batches:
        data, offsets = batch_bytes(batch.column(2))
        for doc_id, known, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n = 0
            for piece in pieces(data[a:b].tobytes().translate(LOWER)):
                found = piece.split()
                tokens.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                n += len(found)
            ids.append(doc_id)
            train.append(known)
            lengths.append(n)
            size += n + 1
            if size >= CHUNK:
                yield record(words, ids, train, lengths, tokens)
                done += 1
                words, ids, train, lengths, tokens, size = Words(), [], [], [], [], 0
    if ids:
        yield record(words, ids, train, lengths, tokens)


class Vocabulary:
    """What every task knows of the corpus: totals, the frequent words and the classes' totals. Bounded by ``FREQUENT`` and ``CLASSES``."""

    def __init__(self, tokens: int, distinct: int, ends: int, frequent: dict[int, int], classes: dict[int, tuple[int, int]]) -> None:
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.frequent = np.array(sorted(frequent), np.int64)
        self.class_tokens, self.class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for c, (total, words) in classes.items():
            self.class_tokens[c], self.class_words[c] = total, words
        own = np.array([ends, *(frequent[k] for k in self.frequent.tolist())], np.float64)
        #: corpus share of each symbol: the end token, frequent words, classes
        self.shares = (np.concatenate([own, self.class_tokens]) + 1.0) / (own.sum() + self.class_tokens.sum() + len(own) + CLASSES)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.distinct + 1.0))

    def symbols(self, keys: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each word, and the log10 of its share of that symbol. ``keys`` are 0 for words that aren't frequent."""
        at = np.searchsorted(self.frequent, keys)
        own = keys != 0
        share = np.log10((counts + 1.0) / (self.class_tokens[classes] + self.class_words[classes] + 1.0))
        return np.where(own, at + 1, 1 + len(self.frequent) + classes), np.where(own, 0.0, share)


def _recoded(vocabulary: Vocabulary, chunk: int, body: bytes, places: list[np.ndarray], known: list[np.ndarray], often: list[np.ndarray]) -> pa.RecordBatch:
    """The documents of a chunk as symbols, given the counts of its known words."""
    names = [part.split()[0] for part in CODED.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    ids, train, lengths, classes, tokens = unpacked(body)
    counts, keys = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
    for at, count, key in zip(places, known, often, strict=True):
        counts[at], keys[at] = count, key
    symbol, within = vocabulary.symbols(keys, counts, classes)
    ends = np.concatenate([[0], np.cumsum(lengths)])

    def sums(per_word: np.ndarray) -> np.ndarray:
        every = per_word[tokens]
        return np.array([every[a:b].sum() for a, b in zip(ends[:-1], ends[1:], strict=True)])

    coded = np.insert(symbol.astype("<u2")[tokens], ends[1:], 0)
    bounds = ends + np.arange(len(ends))
    part = (mix(np.uint64(chunk) + np.arange(len(lengths), dtype=np.uint64)) % np.uint64(PARTS)).astype(np.int32)
    columns = [
        ids, train, part, lengths + 1, sums((counts > 0).astype(np.int64)).astype(np.int64) + (vocabulary.ends > 0),
        sums(vocabulary.base(counts)) + vocabulary.base(np.float64(vocabulary.ends)), sums(within),
        [coded[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _recode(vocabulary: Vocabulary):
    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's own row comes first, then a row for each of its known words."""
        chunk, body, places, known, often = None, None, [], [], []
        for batch in batches:
            at, count, key = (batch.column(c).to_numpy() for c in (1, 2, 3))
            edges = np.unique([0, *np.flatnonzero(at < 0), len(at)]).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if at[a] < 0:
                    if body is not None:
                        yield _recoded(vocabulary, chunk, body, places, known, often)
                    chunk, body, places, known, often = batch.column(0)[a].as_py(), batch.column(4)[a].as_py(), [], [], []
                    a += 1
                places.append(at[a:b])
                known.append(count[a:b])
                often.append(key[a:b])
        if body is not None:
            yield _recoded(vocabulary, chunk, body, places, known, often)

    return recode


# the model --------------------------------------------------------------------------------------------------------


class Model:
    """Start, move and emission probabilities. ``emit`` is symbols by states; ``shares`` are the states' shares of all tokens."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> None:
        self.start, self.move, self.emit, self.shares = start, move, emit, shares

    @classmethod
    def first(cls, vocabulary: Vocabulary, states: int = STATES) -> Model:
        """Corpus shares, shifted by a hash of symbol and state; states that last."""
        n = len(vocabulary.shares)
        noise = mix(np.arange(1, n * states + 1, dtype=np.uint64)).reshape(n, states) / 2.0**64
        emit = vocabulary.shares[:, None] * np.exp(3 * noise)
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        even = np.full(states, 1 / states)
        return cls(even, move, emit / emit.sum(axis=0), even)

    @classmethod
    def of_counts(cls, counts: Counts, vocabulary: Vocabulary) -> Model:
        emit = counts.emit + EMISSION_PRIOR * vocabulary.shares[:, None]
        move = counts.move + MOVE_PRIOR
        start, total = counts.start + MOVE_PRIOR, counts.emit.sum(axis=0) + MOVE_PRIOR
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), total / total.sum())


class Counts:
    """Expected counts of starts, moves and emissions."""

    def __init__(self, states: int, symbols: int) -> None:
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))

    def rows(self) -> np.ndarray:
        return np.concatenate([self.start[None], self.move, self.emit])

    @classmethod
    def of_rows(cls, rows: np.ndarray) -> Counts:
        states = rows.shape[1]
        out = cls(0, 0)
        out.start, out.move, out.emit = rows[0], rows[1 : states + 1], rows[states + 1 :]
        return out


def in_step(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first: their order, their symbols one column a place, and how many reach each place."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    table = np.zeros((lengths.max(), len(sequences)), np.int64)
    for column, i in enumerate(order.tolist()):
        table[: lengths[i], column] = sequences[i]
    alive = len(sequences) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), "right")
    return order, table, alive


def likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence, by the scaled forward recursion."""
    order, table, alive = in_step(sequences)
    out, state = np.zeros(len(sequences)), np.tile(model.start, (len(sequences), 1))
    for t, n in enumerate(alive.tolist()):
        state = (state[:n] @ model.move if t else state) * model.emit[table[t, :n]]
        scale = state.sum(axis=1)
        out[:n] += np.log10(scale)
        state /= scale[:, None]
    back = np.zeros_like(out)
    back[order] = out
    return back


def expect(model: Model, sequences: list[np.ndarray], begins: np.ndarray, counts: Counts) -> None:
    """Adds the expected counts of the sequences; those that don't begin a text start from the states' shares."""
    order, table, alive = in_step(sequences)
    begins, steps, states = begins[order], len(table), len(model.start)
    state = np.where(begins[:, None], model.start, model.shares)
    ahead, emitted, scales = [], [], []
    for t, n in enumerate(alive.tolist()):
        e = model.emit[table[t, :n]]
        state = (state[:n] @ model.move if t else state) * e
        scale = state.sum(axis=1, keepdims=True)
        state = state / scale
        ahead.append(state)
        emitted.append(e)
        scales.append(scale)
    behind = np.ones((alive[-1], states))
    flat, weights = [], []
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        if t < steps - 1:
            m = alive[t + 1]
            drawn = emitted[t + 1] * behind / scales[t + 1]
            counts.move += model.move * (ahead[t][:m].T @ drawn)
            behind = np.concatenate([drawn @ model.move.T, np.ones((n - m, states))])
        flat.append(table[t, :n])
        weights.append(ahead[t] * behind)
    counts.start += weights[-1][begins].sum(axis=0)
    flat, weights = np.concatenate(flat), np.concatenate(weights)
    for k in range(states):
        counts.emit[:, k] += np.bincount(flat, weights[:, k], len(counts.emit))


def _sequences(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = batch_bytes(column)
    whole = data.view("<u2") if not data.ctypes.data % 2 else np.frombuffer(data.tobytes(), "<u2")
    return (whole[a:b] for a, b in zip((offsets[:-1] // 2).tolist(), (offsets[1:] // 2).tolist(), strict=True))


def _expect(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(len(model.start), len(model.emit))
        held, begins = [], []

        def settle() -> None:
            by_length = np.argsort([len(s) for s in held], kind="stable")
            for at in range(0, len(held), 512):
                part = by_length[at : at + 512].tolist()
                expect(model, [held[i] for i in part], np.array([begins[i] for i in part]), counts)
            held.clear()
            begins.clear()

        for batch in batches:
            for s in _sequences(batch.column(0)):
                for at in range(0, len(s), SEGMENT):
                    held.append(s[at : at + SEGMENT])
                    begins.append(at == 0)
                if len(held) >= 8192:
                    settle()
        if held:
            settle()
        rows = counts.rows()
        seen = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *(pa.array(rows[seen, k]) for k in range(rows.shape[1]))], ["row", *(f"s{k}" for k in range(rows.shape[1]))])

    return run


def _score(model: Model, train_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, lengths = list(_sequences(batch.column(6))), batch.column(2).to_numpy()
            score, by_length = np.zeros(len(held)), np.argsort(lengths, kind="stable")
            at = 0
            while at < len(held):  # as many at once as make a table of a few million places, one at least
                end = at + 1
                while end < len(held) and end - at < 1024 and lengths[by_length[end]] * (end + 1 - at) <= 1 << 21:
                    end += 1
                part = by_length[at:end]
                score[part] = likelihoods(model, [held[i] for i in part.tolist()])
                at = end
            columns = [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(np.full(len(held), train_tokens)), batch.column(4)]
            names = [part.split()[0] for part in SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score + batch.column(5).to_numpy())], names)

    return run


# passes -----------------------------------------------------------------------------------------------------------


def training() -> Column:
    """Whether a document is one to learn from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def encode(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """The documents as symbols (stored), and the vocabulary."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training().alias("train"), "text")
    chunks = stored(rows.mapInArrow(_chunks, CHUNKS), "chunks")
    entry = F.posexplode(F.arrays_zip("keys", "counts", "classes")).alias("at", "w")
    pairs = chunks.select("chunk", entry).select("chunk", "at", F.col("w.keys").alias("key"), F.col("w.counts").alias("n"), F.col("w.classes").alias("class"))
    counted = pairs.filter("n > 0").groupBy("key").agg(F.sum("n").alias("count"), F.first("class").alias("class"))
    words = stored(counted, "word-counts")
    ends = rows.filter("train").count()
    total, distinct = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    tokens = total + ends
    often = F.col("count") * FREQUENT >= tokens
    frequent = {r["key"]: r["count"] for r in words.filter(often).select("key", "count").collect()}  # FREQUENT rows at most
    by_class = words.filter(~often).groupBy("class").agg(F.sum("count"), F.count("*")).collect()  # CLASSES rows at most
    vocabulary = Vocabulary(tokens, distinct + (ends > 0), ends, frequent, {c: (n, v) for c, n, v in by_class})

    head, zero = F.lit(-1).alias("at"), F.lit(0).cast("long")
    own = chunks.select("chunk", head, zero.alias("count"), zero.alias("often"), "body")
    marked = words.select("key", "count", F.when(often, F.col("key")).otherwise(zero).alias("often"))
    known = pairs.select("key", "chunk", "at").join(marked, "key").select("chunk", "at", "count", "often", F.lit(None).cast("binary").alias("body"))
    dealt = own.unionByName(known).repartition(partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk", "at")
    coded = dealt.mapInArrow(_recode(vocabulary), CODED)
    return stored(coded, "symbols"), vocabulary


def train(coded: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: tuple = ROUNDS) -> Model:
    """Baum-Welch over the documents of ``coded`` to learn from."""
    model = Model.first(vocabulary, states)
    shape = (1 + states + len(vocabulary.shares), states)
    names = [f"s{k}" for k in range(states)]
    schema = "row int, " + ", ".join(f"{n} double" for n in names)
    for share, times in rounds:
        own = coded.filter(F.col("train") & (F.col("part") < share)).select("symbols")
        for _ in range(times):
            sums = own.mapInArrow(_expect(model), schema).groupBy("row").agg(*(F.sum(n).alias(n) for n in names))
            rows = np.zeros(shape)
            found = sums.toArrow()  # a row for each symbol and state at most
            rows[found["row"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], axis=1)
            model = Model.of_counts(Counts.of_rows(rows), vocabulary)
    return model


def score_texts(docs: DataFrame, states: int = STATES, rounds: tuple = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``."""
    coded, vocabulary = encode(docs)
    model = train(coded, vocabulary, states, rounds)
    rows = coded.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "base_score", "within", "symbols")
    return rows.mapInArrow(_score(model, int(vocabulary.tokens)), SCORED)
