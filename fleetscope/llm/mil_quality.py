"""Document quality by attention over passages (multiple-instance learning).

A text is a bag of passages of ``PASSAGE`` words. Each passage becomes shares of hashed words and of kinds of characters, and
a small tanh layer encodes it. Gated attention, learnt from the documents' labels alone, weighs the encoded passages; a logistic
unit scores their weighted sum.

Fitting takes at most ``TRAIN_DOCS`` labelled documents (those with the least hash of doc_id) and of each at most
``TRAIN_PASSAGES`` passages (drawn evenly) to the driver as features, 104 MB however long the texts are; these are the documented bounds. Everything else, features and scores of all documents, runs in tasks on whole texts. The weights
(some 10,000 numbers) go with the tasks.

Defined results: null and wordless texts have one passage of zeros and so a score; rows are scored one by one; labels that
are null, or whose document is missing, teach nothing; without labels of both kinds every score is the share of label 1
(0.5 without any). Columns of the input are kept, except ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import batch_bytes

PASSAGE = 64
BINS = 256
TRAIN_DOCS = 6_000
TRAIN_PASSAGES = 32  # of a document, drawn if it has more
HIDDEN, GATE = 24, 12
EPOCHS, BAGS, RATE, DECAY = 30, 64, 0.01, 1e-4

SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Kinds of bytes whose shares describe a passage.
KINDS = np.stack(
    [
        np.isin(np.arange(256), list(range(65, 91))),
        np.isin(np.arange(256), list(range(97, 123))),
        np.isin(np.arange(256), list(b"0123456789")),
        np.isin(np.arange(256), list(b".")),
        np.isin(np.arange(256), list(b",;:")),
        np.isin(np.arange(256), list(b"!?")),
        np.isin(np.arange(256), list(b"|")),
        np.isin(np.arange(256), list(b"#*$%&@^~_=+")),
        np.isin(np.arange(256), list(b"<>{}[]()/\\")),
        np.isin(np.arange(256), list(b"\n")),
        np.arange(256) >= 128,
    ]
).astype(np.int32)
WIDTH = BINS + len(KINDS) + 3
BASE = np.uint64(0x9FB21C651E98DF25)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of texts that lie one after the other, and the number of passages of each."""
    n_docs = len(offsets) - 1
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = solid[firsts]
    starts = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(doc, minlength=n_docs)
    ordinal = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    counts = np.maximum(1, -(-words // PASSAGE))
    base = np.cumsum(counts) - counts
    passage = base[doc] + ordinal // PASSAGE
    out = np.zeros((int(counts.sum()), WIDTH), np.float32)
    if not len(starts):
        return out, counts

    ends = np.flatnonzero(solid & ~np.concatenate([solid[1:] & ~begins[1:], [False]])) + 1
    lengths = ends - starts
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), BASE)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), INVERSE)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        hashes = (sums[ends] - sums[starts]) * back[starts]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    here = np.bincount(passage, minlength=len(out)).astype(np.float32)
    out[:, :BINS] = np.bincount(passage * BINS + bins, minlength=len(out) * BINS).reshape(-1, BINS)
    out[:, :BINS] = np.sqrt(out[:, :BINS] / np.maximum(here, 1)[:, None])

    heads = np.flatnonzero(ordinal % PASSAGE == 0)
    which, begin = passage[heads], starts[heads]
    end = np.append(begin[1:], len(data))
    end = np.minimum(end, offsets[doc[heads] + 1])
    size = np.maximum(end - begin, 1).astype(np.float32)
    for k, kind in enumerate(KINDS):
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        out[which, BINS + k] = np.sqrt((total[end] - total[begin]) / size)
    order = np.lexsort((hashes, passage))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])])
    distinct = np.bincount(passage[order][new], minlength=len(out))
    at = BINS + len(KINDS)
    out[:, at] = distinct / np.maximum(here, 1)
    out[:, at + 1] = np.bincount(passage, lengths, len(out)) / np.maximum(here, 1) / 16
    out[:, at + 2] = here / PASSAGE
    return out, counts


def _drawn(passages: np.ndarray) -> np.ndarray:
    if len(passages) <= TRAIN_PASSAGES:
        return passages
    some = np.random.default_rng(len(passages)).choice(len(passages), TRAIN_PASSAGES, replace=False)
    return passages[np.sort(some)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            found, counts = features(*batch_bytes(part.column(1)))
            rows = [_drawn(r) for r in np.split(found, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], ["label", "passages"]
            )


class Attention:
    """Encoder, gated attention and scoring unit."""

    def __init__(self, seed: int = 0) -> None:
        draw = np.random.default_rng(seed)
        shape = lambda *s: (draw.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "W": shape(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": shape(HIDDEN, GATE), "U": shape(HIDDEN, GATE),
            "w": shape(GATE), "c": shape(HIDDEN), "d": np.zeros(1, np.float32),
        }
        self.mean, self.spread = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, starts = self.p, np.cumsum(counts) - counts
        h = np.tanh((x - self.mean) / self.spread @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "starts": starts}

    def gradient(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, counts)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        dy = (f["y"] - labels) / len(labels)
        dz = np.repeat(dy[:, None] * p["c"], counts, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, f["starts"]), counts))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {
            "W": ((x - self.mean) / self.spread).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> None:
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return
        draw = np.random.default_rng(seed)
        every = np.concatenate(bags)
        self.mean, self.spread = every.mean(0), every.std(0) + 0.02
        self.p["d"][:] = np.log(labels.mean() / (1 - labels.mean()))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            order = draw.permutation(len(bags))
            for at in range(0, len(order), BAGS):
                some, step = order[at : at + BAGS], step + 1
                counts = np.array([len(bags[i]) for i in some])
                for k, g in self.gradient(np.concatenate([bags[i] for i in some]), counts, labels[some]).items():
                    g = g + DECAY * self.p[k] * (k not in "bd")
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return self.forward(*features(data, offsets))["y"].astype(np.float64)


def fit_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Attention:
    """A model from ``labels`` (``doc_id, label``) and the texts of ``docs``."""
    some = labels.filter("label is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_docs)
    texts = docs.select("doc_id", "text").join(some, "doc_id").select(F.col("label").cast("double").alias("label"), "text")
    rows = texts.mapInArrow(_features, "label double, passages binary").collect()
    rows.sort(key=lambda r: (r["passages"], r["label"]))  # the order of tasks must not matter
    bags = [np.frombuffer(r["passages"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    model = Attention()
    model.fit(bags, np.array([r["label"] for r in rows], np.float32))
    return model


def score_quality(docs: DataFrame, model: Attention) -> DataFrame:
    """``docs`` with ``score``: how likely label 1 is."""

    def score(text: pa.Array) -> pa.Array:
        data, offsets = batch_bytes(text)
        out = [model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _parts(offsets)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    docs = docs.drop("score")
    return docs.withColumn("score", F.arrow_udf(score, "double")("text"))


def _parts(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b
