"""Compression bands, token files, decontamination and the quality model."""

from __future__ import annotations

import base64
import random
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetscope.llm import decontamination, mil_quality, quality_rules, token_files
from fleetscope.llm.common import new_path
from fleetscope.llm.queries import QUERIES
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
EDGES = [None, "", " \n\t", "a", "word " * 60, "one two three " * 40, "#*$%&|<>" * 30, "l\n\n l\nl\r\nl\n" * 3, "\x1c\x85\xa0 x y", "é😀 ß" * 100, "x" * 300_000]


def _docs(spark, texts, parts=2):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


# compression bands ------------------------------------------------------------------------------------------------


def _prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 9))) for _ in range(600)]
    return " ".join(draw.choice(words) for _ in range(n))


def test_base_figures_equal_brute_force(spark):
    texts = [*EDGES, *[_prose(n, 30 * n) for n in range(1, 12)], _prose(1, 80) + "\n" + "\n".join(["same line here"] * 9)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in quality_rules.compression_bands(_docs(spark, texts)).collect()}
    for n, t in enumerate(texts):
        r = got[n]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_figures(t), repr(t)[:60]


def test_bands_reject_repetitive_and_random_texts(spark):
    noise = lambda n: base64.b64encode(np.random.default_rng(n).bytes(n)).decode()
    digits = np.random.default_rng(1).integers(0x4E00, 0x9FFF, 6000)
    spread = " ".join(chr(c) + chr(d) + "xQ7" for c, d in zip(digits[::2], digits[1::2]))
    rare = "".join(chr(33 + c) if c % 9 else " " for c in np.random.default_rng(2).integers(0, 94, 40_000))
    texts = [_prose(1, 300), _prose(2, 5000), " ".join(f"a{n % 9}" for n in range(3000)), _prose(3, 300) + " spam offer" * 900, rare, noise(30), spread]
    got = {r.doc_id: r.kept for r in quality_rules.compression_bands(_docs(spark, texts)).collect()}
    assert [got[n] for n in range(5)] == [True, True, False, False, False]


def test_a_junk_part_shows_in_the_chunks(spark):
    text = _prose(4, 4000) + " ".join(f"k{n % 3} v{n % 2}" for n in range(3000))
    row = quality_rules.compression_bands(_docs(spark, [text])).first()
    assert row.bad_chunk_share > quality_rules.BAD_SHARE and not row.kept


def _wrapped(text: str, width: int) -> str:
    return " ".join(text[at : at + width] for at in range(0, len(text), width))


@pytest.mark.parametrize("size", [450, 900, 1900, 3900, 7000, 15_000, 20_000, 60_000, 140_000, 200_000])
def test_coded_and_random_texts_fail_at_every_length(size):
    draw = np.random.default_rng(size)
    raw = draw.bytes(size)
    codes = {
        "base64": base64.b64encode(raw).decode()[:size],
        "hex": raw.hex()[:size],
        "ascii": draw.integers(33, 127, size).astype(np.uint8).tobytes().decode(),
    }
    pack = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    for name, text in codes.items():
        for width in (8, 12, 76) if size > 5000 else (8,):
            row = quality_rules.judge(_wrapped(text, width).encode(), pack)
            assert row[5] or not row[8], (name, width)
        assert not quality_rules.in_band(_wrapped(text, 76).encode(), len(pack.compress(_wrapped(text, 76).encode()))), name


def _texts_of(spark) -> list[str]:
    return [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]


def test_half_repeated_texts_fail_and_prose_stays(spark):
    pack = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    clean = [t.encode() for t in _texts_of(spark)]
    judged = [quality_rules.judge(t, pack) for t in clean]
    base = [t for t, r in zip(clean, judged) if not r[5]]
    lost = sum(not r[5] and not r[8] for r in judged)
    assert len(base) > 500 and lost <= 0.001 * len(base)
    words = b" ".join(sorted(base)).split()
    for n, block, times in [(56, 9, 3), (80, 10, 4), (150, 14, 5), (300, 40, 3), (700, 40, 6), (1500, 40, 16), (3300, 40, 33), (25_000, 40, 290)]:
        for apart in (False, True):
            own = words[1000 : 1000 + n - block * times]
            part = words[-block:]
            step = len(own) // times
            rows = [own[k * step : (k + 1) * step] for k in range(times)] + [own[times * step :]]
            text = b" ".join(w for row in rows for w in [*row, *(part if apart and row is not rows[-1] else [])]) if apart else b" ".join(own + part * times)
            assert not quality_rules.judge(text, pack)[8], (n, block, apart)


def test_other_scripts_keep_wide_limits():
    pack = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    draw = random.Random(5)
    words = ["".join(chr(draw.randrange(0xAC00, 0xAC00 + 900)) for _ in range(draw.randint(1, 4))) for _ in range(3000)]
    text = " ".join(draw.choice(words) for _ in range(1500)).encode()
    assert len(text) / len(pack.compress(text)) > 1.25 and quality_rules.judge(text, pack)[8]


def test_clashing_columns_are_replaced(spark):
    docs = _docs(spark, ["x"]).withColumns({"kept": F.lit("old"), "N_words": F.lit("old"), "lang": F.lit("en")})
    got = quality_rules.compression_bands(docs)
    assert got.first().n_words == 1 and got.first().lang == "en" and len(got.columns) == 3 + len(quality_rules.COLUMNS)
    assert quality_rules.compression_bands(docs.limit(0)).count() == 0


# token files ------------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


def _library(texts, path=PATH):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB cé É.,'!?09<|\n\t́ ß#Σ“”s'tl"), max_size=30) | st.text(max_size=20) | st.just("x<|endoftext|> end's ok."), max_size=6))
def test_words_apart_give_the_librarys_ids(texts):
    encoder = ENCODERS.setdefault(0, token_files.WordEncoder(open(PATH).read(), 2))
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = encoder.encode([t.encode() for t in texts])
    assert len(counts) == len(texts) and int(counts.sum()) == len(ids)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == [[*x, 2] for x in _library(texts)] or not texts


@pytest.mark.parametrize("change", ["none", "cased", "marks", "rule"])
def test_other_vocabularies_get_the_librarys_ids_too(change):
    """Vocabularies of the same kind but with another normalizer or word rule are encoded whole."""
    from tokenizers import Tokenizer

    vocabulary = json.loads(open(PATH).read())
    if change == "none":
        vocabulary["normalizer"] = None
    elif change == "cased":
        vocabulary["normalizer"]["normalizers"].pop()
    elif change == "marks":
        vocabulary["normalizer"]["normalizers"].append({"type": "StripAccents"})
    else:
        vocabulary["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[^\s\p{L}\p{N}]+|[\p{L}]+|[\p{N}]+"}
    text = json.dumps(vocabulary)
    texts = ["Hello World", "ÉTÉ, 12 Don't", "a  b\n C"]
    want = [[*e.ids, 2] for e in Tokenizer.from_str(text).encode_batch(texts, add_special_tokens=False)]
    ids, counts = token_files._encoder(text, 2).encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert token_files.cuts_at_spaces(json.loads(open(PATH).read())) and not token_files.cuts_at_spaces(vocabulary)


ENCODERS: dict = {}


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 5)
    monkeypatch.setattr(token_files, "KEPT_PARTS", 60)
    encoder = token_files.WordEncoder(open(PATH).read(), 2)
    texts = [_prose(n % 3, 40) for n in range(9)]
    for t, want in zip(texts, _library(texts)):
        assert encoder.encode([t.encode()])[0].tolist() == [*want, 2]


@pytest.mark.parametrize(("file", "bits"), [("word_bpe_49k.json", 16), ("byte_bpe_50k.json", 16)])
def test_files_hold_the_librarys_ids(spark, file, bits):
    texts = [*EDGES, *[_prose(n, 50) for n in range(40)]]
    rows = [(None if n == 3 else n * 7 % 53, t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    folder = f"file://{new_path(spark, 'ids').removeprefix('file://')}"
    manifest = token_files.write_token_files(docs, public_tokenizers.path(file), folder, 2)
    got = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (d, _), ids in zip(got, order, _library([t for _, t in order], public_tokenizers.path(file)), strict=True):
        ids = [*ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    parts = manifest.orderBy("part").collect()
    assert parts[0].bits == bits and parts[-1].base + parts[-1].n_ids == at
    ids, offsets, names = token_files.open_part(folder, parts[0].path, bits)
    assert isinstance(ids, np.memmap) and ids.dtype == np.dtype(f"<u{bits // 8}") and offsets.dtype == np.dtype("<i8") and len(offsets) == len(names) + 1


def test_no_documents_no_files(spark):
    folder = f"file://{new_path(spark, 'ids').removeprefix('file://')}"
    manifest = token_files.write_token_files(_docs(spark, []), PATH, folder, 2)
    assert token_files.read_token_files(manifest, folder).count() == 0


# decontamination --------------------------------------------------------------------------------------------------


def test_contamination_equals_brute_force(spark):
    draw = random.Random(17)
    words = ["ha", "the", "Of", "x1", "é", "ÉÀ", "on", "a"]
    prose = lambda n: " ".join(draw.choice(words) + draw.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(n, prose(draw.randint(1, 40))) for n in range(30)] + [(100, None), (101, "..."), (102, "ha " * 30), (None, prose(20)), (7, prose(15))]
    docs = [(n, prose(draw.randint(0, 120))) for n in range(60)]
    for n in range(60, 110):
        own = items[draw.randrange(30)][1].split()
        a = draw.randrange(len(own))
        docs.append((n, f"{prose(20)} {' '.join(own[a:]).upper()} {prose(9)}"))
    docs += [(200, None), (201, ""), (202, "ha " * 300), (203, items[3][1] * 2)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(0))
    got = {r.doc_id: r for r in decontamination.find_contamination(table, bench).collect()}
    for d, n, hit, names in brute.contamination(docs, items):
        r = got[d]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, hit, names), d
        assert sum(s.end - s.start for s in r.spans) == hit


def test_rows_with_one_id_are_judged_apart(spark):
    passage = " ".join(f"w{n}" for n in range(20))
    docs = spark.createDataFrame([(1, passage), (1, "other words " * 10), (None, passage), (None, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, passage)], "item_id long, text string")
    got = sorted((r.n_words, r.n_hit) for r in decontamination.find_contamination(docs, bench).collect())
    assert got == [(1, 0), (20, 0), (20, 20), (20, 20)]


def test_empty_tables_hit_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = _docs(spark, ["a b c", None])
    assert decontamination.find_contamination(docs, bench).filter("n_hit > 0").count() == 0
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0


# quality model ----------------------------------------------------------------------------------------------------


def test_gradient_equals_differences():
    draw = np.random.default_rng(0)
    model = mil_quality.Attention(1)
    counts, x = np.array([2, 1, 4]), draw.standard_normal((7, mil_quality.WIDTH))
    labels = np.array([1.0, 0.0, 1.0])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss() -> float:
        y = model.forward(x, counts)["y"]
        return float(-(labels * np.log(y) + (1 - labels) * np.log(1 - y)).mean())

    for name, g in model.gradient(x, counts, labels).items():
        flat, at = model.p[name].reshape(-1), draw.integers(model.p[name].size)
        kept = flat[at]
        flat[at] = kept + 1e-5
        high = loss()
        flat[at] = kept - 1e-5
        low = loss()
        flat[at] = kept
        assert abs((high - low) / 2e-5 - np.asarray(g).reshape(-1)[at]) < 1e-6, name


def test_features_do_not_depend_on_the_neighbours():
    texts = [b"", b"one", b"  two words\n" * 70, "é ß|### A1".encode() * 30, b" ", b"end"]
    join = lambda ts: mil_quality.features(np.frombuffer(b"".join(ts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in ts])]))
    every, counts = join(texts)
    for t, found in zip(texts, np.split(every, np.cumsum(counts)[:-1])):
        assert np.allclose(found, join([t])[0], atol=1e-6)


def test_a_bad_passage_is_found_in_long_texts(spark):
    draw = random.Random(3)
    texts, labels = [], []
    for n in range(400):
        parts = [_prose(n % 7, 60) for _ in range(draw.randint(1, 6))]
        if n % 3 == 0:
            parts[draw.randrange(len(parts))] = " ".join("buy now!!" for _ in range(60))
        texts.append(" ".join(parts))
        labels.append((n, 0 if n % 3 == 0 else 1))
    docs = _docs(spark, [*texts, None, ""])
    table = spark.createDataFrame(labels, "doc_id long, label int")
    model = mil_quality.fit_quality(docs, table.filter("doc_id < 300"))
    got = {r.doc_id: r.score for r in mil_quality.score_quality(docs, model).collect()}
    right = [(got[n] >= 0.5) == bool(y) for n, y in labels if n >= 300]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == 402


def test_held_out_quality_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_mil_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97


@pytest.mark.parametrize("labels", [[], [(0, 1)], [(0, None), (9, 1)]])
def test_labels_of_one_kind_give_their_share(spark, labels):
    docs = _docs(spark, ["a b", None]).withColumn("score", F.lit("clash"))
    model = mil_quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    assert {r.score for r in mil_quality.score_quality(docs, model).collect()} == {1.0 if labels[:1] == [(0, 1)] else 0.5}


def test_many_rows_without_an_id_are_judged_as_fast_as_with_ids(spark):
    """5,000 documents, each with an item of its own in it: no row is held against another's items."""
    items = [(str(i), " ".join(f"w{i}x{j}" for j in range(14))) for i in range(5000)]
    rows = [(None if i % 2 else 7, f"start {t} end {i % 5}") for i, (_, t) in enumerate(items)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.find_contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench).select("doc_id", "n_words", "n_hit", "items").collect()
    assert len(got) == 5000 and all((r.n_words, r.n_hit, len(r["items"])) == (17, 14, 1) for r in got)
    assert sorted(r["items"][0] for r in got) == sorted(i for i, _ in items)


def test_grams_are_taken_from_slices_of_a_batch(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(n)) for n in (0, 5, 30, 4000, 13, 0, 200, 200, 1, 60)]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, ["_key", "_print", "text"])
    sizes, kept = [], decontamination.kept_grams
    monkeypatch.setattr(decontamination, "kept_grams", lambda hashes, *rest: sizes.append(len(hashes)) or kept(hashes, *rest))
    every = bytes([255]) * (decontamination.FILTER_BITS // 8)
    found = lambda: sorted(r for b in decontamination._document_grams(every, (5,))(iter([batch])) for r in zip(*b.to_pydict().values()))
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 1 << 20)
    whole = found()
    assert sizes == [sum(len(t.split()) for t in texts)] and whole
    sizes.clear()
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 300)
    assert found() == whole
    assert sum(sizes) == sum(len(t.split()) for t in texts) and sorted(sizes)[-2:] == [200, 4000]
    assert [list(decontamination.slices(np.array(s), 4)) for s in ([], [9], [0, 0], [2, 2, 1, 9, 0, 4])] == [[], [(0, 1)], [(0, 2)], [(0, 2), (2, 3), (3, 4), (4, 6)]]
