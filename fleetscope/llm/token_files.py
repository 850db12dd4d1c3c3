"""Token ids as flat files of unsigned integers with 64-bit document offsets, to be memory-mapped.

Documents are range-partitioned and sorted by doc_id. Each partition streams its ids into three files::

    part-00012.bin   ids, little-endian, 16 bits if every id of the vocabulary fits, else 32
    part-00012.idx   int64: first id of each document within the file, then the number of ids
    part-00012.docs  int64: doc_id of each document

The manifest (one row for each partition) holds the files' counts; its prefix sums are the partitions' bases, so the place of
a document among all ids is its partition's base plus its own offset, and no file is written twice. A task writes to names
of its own and renames them at the end, so a repeated task leaves the same files.

Defined results: a null text is empty and has the end id alone; a null doc_id comes first and is read back as null; rows with
equal doc_id keep their own entries, in an order of their texts; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.llm.common import batch_bytes, partitions, stored

NO_ID = -(1 << 63)  # stands for a null doc_id in a file
KEPT_WORDS, KEPT_PARTS = 600_000, 600_000  # that a worker remembers
MANIFEST = "part int, path string, bits int, n_docs long, n_ids long"

#: Letters whose lower case is one letter, then ASCII punctuation without the apostrophe: the vocabulary's word rule cuts
#: between the two and nowhere else, so each part is one word of the vocabulary's and is encoded and kept by itself.
WORD_THEN_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
AT_ONCE = 500  # parts encoded by one call


END = b" "  # no word; stands for the end of a text


class WordEncoder:
    """Ids of whole texts, from ids of their white-space separated words, each kept in one table; new words are put together
    from parts, which are encoded once and remembered too.

    Right for tokenizers that never join characters across white space, drop it, and mark the last id of a word.
    """

    def __init__(self, tokenizer_json: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(tokenizer_json), end_id
        model = json.loads(tokenizer_json)["model"]
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)  # ids that end a word
        self.last[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
        self._forget()

    def _forget(self) -> None:
        self.parts: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 16, np.int64)  # of the ids of each part; the first part is empty
        self._forget_words()

    def _forget_words(self) -> None:
        self.words: dict[bytes, int] = {END: 0}
        self.word_ids = np.full(1 << 16, self.end_id, np.uint32)
        self.word_bounds = np.zeros(1 << 16, np.int64)
        self.word_bounds[1] = 1

    def _encode_parts(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _keep(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.parts)
        used = int(self.bounds[n])
        self.parts.update(zip(parts, range(n, n + len(parts)), strict=True))
        while len(self.bounds) <= n + len(parts):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(ids)] = ids
        self.bounds[n + 1 : n + len(parts) + 1] = used + np.cumsum(counts)

    def _learn(self, words: list[bytes]) -> None:
        split = []
        single, other = {}, {}  # new parts: one word of the vocabulary's, or any number
        for w in words:
            text = w.decode()
            found = WORD_THEN_MARKS.fullmatch(text)
            pair = (found[1].lower(), found[2]) if found else (text, "")
            split.append(pair)
            for part in pair:
                if part not in self.parts:
                    (single if found else other)[part] = None
        single = [p for p in single if p not in other]
        if single:
            rows = self._encode_parts([" ".join(single[i : i + AT_ONCE]) for i in range(0, len(single), AT_ONCE)])
            ids = np.array([i for r in rows for i in r], np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(single):
                raise ValueError("the vocabulary cuts words otherwise than its rule says")
            self._keep(single, ids, np.diff(ends, prepend=0))
        if other:
            rows = self._encode_parts(list(other))
            self._keep(list(other), np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows]))
        two = np.array([(self.parts[a], self.parts[b]) for a, b in split], np.int64).ravel()
        ids, counts = _gathered(self.ids, self.bounds, two)
        counts = counts.reshape(-1, 2).sum(axis=1)
        n, used = len(self.words), int(self.word_bounds[len(self.words)])
        while len(self.word_bounds) <= n + len(words):
            self.word_bounds = np.concatenate([self.word_bounds, np.zeros_like(self.word_bounds)])
        while len(self.word_ids) < used + len(ids):
            self.word_ids = np.concatenate([self.word_ids, np.zeros_like(self.word_ids)])
        self.word_ids[used : used + len(ids)] = ids
        self.word_bounds[n + 1 : n + len(words) + 1] = used + np.cumsum(counts)
        self.words.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's with the end id, and how many each text has."""
        if len(self.parts) > KEPT_PARTS:
            self._forget()
        elif len(self.words) > KEPT_WORDS:
            self._forget_words()
        words, sizes = [], []
        for text in texts:
            words += text.split()
            words.append(END)
            sizes.append(len(words))
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missed = [words[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(missed)))
            at[unknown] = np.fromiter(map(self.words.__getitem__, missed), np.int64, len(missed))
        ids, counts = _gathered(self.word_ids, self.word_bounds, at)
        ends = np.cumsum(counts)[np.array(sizes, np.int64) - 1] if texts else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)


def _gathered(ids: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``at``, one after the other, and how many each has."""
    starts = bounds[at]
    counts = bounds[at + 1] - starts
    ends = np.cumsum(counts)
    return ids[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts


class TextEncoder:
    """Ids by one call a batch: for any tokenizer of the library."""

    def __init__(self, tokenizer_json: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(tokenizer_json), end_id

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return np.array([i for r in rows for i in r], np.uint32), np.array([len(r) for r in rows], np.int64)


#: The steps, as the vocabulary file words them, that ``WordEncoder`` does itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def cuts_at_spaces(tokenizer: dict) -> bool:
    """Whether the vocabulary has exactly the normalizer and word rule of ``WordEncoder``; any other one is left to ``TextEncoder``."""
    model, steps = tokenizer["model"], tokenizer.get("pre_tokenizer")
    plain = model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and tokenizer.get("post_processor") is None
    cut = tokenizer.get("truncation") is None and tokenizer.get("padding") is None
    return plain and cut and tokenizer.get("normalizer") == NORMALIZER and steps == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}


ENCODERS: dict[int, object] = {}  # of this worker, by checksum of the vocabulary file


def _encoder(vocabulary: str, end_id: int):
    key = zlib.crc32(vocabulary.encode(), end_id)
    if key not in ENCODERS:
        ENCODERS[key] = (WordEncoder if cuts_at_spaces(json.loads(vocabulary)) else TextEncoder)(vocabulary, end_id)
    return ENCODERS[key]


def _slices(texts: list[bytes], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _writer(vocabulary: str, folder: str, bits: int, end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(vocabulary, end_id), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, own = f"{root}/part-{part:05d}", f"{root}/.{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        out = {}
        for batch in batches:
            if not out:
                out = {kind: store.open_output_stream(f"{own}.{kind}") for kind in ("bin", "idx", "docs")}
            data, offsets = batch_bytes(batch.column(1))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for a, b in _slices(texts):
                ids, counts = encoder.encode(texts[a:b])
                starts = n_ids + np.cumsum(counts) - counts
                out["bin"].write(ids.astype(f"<u{bits // 8}").tobytes())
                out["idx"].write(starts.astype("<i8").tobytes())
                n_ids += len(ids)
            out["docs"].write(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs += batch.num_rows
        if out:
            out["idx"].write(np.array([n_ids], "<i8").tobytes())
            for kind, stream in out.items():
                stream.close()
                store.move(f"{own}.{kind}", f"{name}.{kind}")
            row = [[part], [f"part-{part:05d}"], [bits], [n_docs], [n_ids]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["part", "path", "bits", "n_docs", "n_ids"])

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_column: str = "doc_id") -> DataFrame:
    """Encodes the ``text`` of all ``docs`` into files in ``folder`` (which executors share) and returns the manifest.

    The vocabulary file is read on the driver and goes with the tasks; it doesn't grow with the data.
    """
    vocabulary = Path(tokenizer_path).read_text()
    model = json.loads(vocabulary)
    top = max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))])
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    manifest = ordered.mapInArrow(_writer(vocabulary, folder, 16 if top < 1 << 16 else 32, end_id), MANIFEST)
    return with_bases(stored(manifest, "token-manifest"))


def with_bases(manifest: DataFrame) -> DataFrame:
    """Adds ``base``, the ids in all earlier partitions. The window holds a row for each partition, not for each document."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def open_part(folder: str, name: str, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and doc_ids of a partition: memory-mapped where the folder is a mounted one, else read."""
    store, root = fs.FileSystem.from_uri(folder)
    out = []
    for kind, dtype in (("bin", f"<u{bits // 8}"), ("idx", "<i8"), ("docs", "<i8")):
        path = f"{root}/{name}.{kind}"
        if isinstance(store, fs.LocalFileSystem):
            out.append(np.memmap(path, dtype, "r") if Path(path).stat().st_size else np.zeros(0, dtype))
        else:
            with store.open_input_file(path) as f:
                out.append(np.frombuffer(f.read(), dtype))
    return tuple(out)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, names = open_part(folder, row["path"], row["bits"])
                for a in range(0, len(names), 10_000):
                    own, bounds = names[a : a + 10_000], offsets[a : a + 10_001]
                    part = np.ascontiguousarray(ids[bounds[0] : bounds[-1]], "<u4")
                    places = bounds - bounds[0]
                    sums = [zlib.crc32(part[x:y]) for x, y in zip(places[:-1], places[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NO_ID), pa.array(row["base"] + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
