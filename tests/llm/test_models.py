"""Conversation repair, whitening and hidden Markov scoring against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter
from math import floor, log10

import numpy as np
import pytest

from fleetscope.llm import conversation_repair as repair
from fleetscope.llm import hidden_markov as hmm
from fleetscope.llm import whitening
from fleetscope.llm.query_list import models

# conversations ----------------------------------------------------------------------------------------------------

SPACE = " \t\n\r\x0b\x0c"


def _ordered(rows):
    filled = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(filled, key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2][:64], hashlib.md5(f"{q[1]}\x01{q[2]}".encode()).hexdigest()))


def _judged(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(SPACE)
        fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append(fault)
    return out


def _brute(rows):
    """Gaps, faults, illegal pairs, cost, letters and repaired turns of one conversation, by a table over prefixes."""
    rows = _ordered(rows)
    faults = _judged(rows)
    best = {"": (0, "", ())}
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def grow(table):
        for _ in range(3):
            for state, (cost, letters, turns) in list(table.items()):
                to = nexts[state]
                option = (cost + 5, letters + "I", (*turns, (name[to], "")))
                table[to] = min(table.get(to, option), option)
        return table

    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def offer(to, option, after=after):
            after[to] = min(after.get(to, option), option)

        for state, (cost, letters, turns) in grow(dict(best)).items():
            offer(state, (cost + 2, letters + "D", turns))
            if fault in (1, 2):
                continue
            more, to = 5 * (fault == 3), nexts[state]
            offer(to, (cost + 1 + more, letters + "R", (*turns, (name[to], text))))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                offer(role[:1], (cost + more, letters + "K", (*turns, (role, text))))
        best = after
    table = grow(dict(best))
    cost, letters, turns = min(table[s] for s in ("", "a") if s in table)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    told = "\n".join(f"{r}:{t}" for r, t in turns)
    counts = [faults.count(k) for k in (1, 2, 3)]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256(told.encode()).hexdigest())


CONV = "conv_id long, turn long, role string, text string"


def _conversations(seed: int):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Why?", "Well,", "So. ", "It is.\t", "a" * 70 + "x.", "a" * 70 + "y.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), draw.choice(roles), draw.choice(texts)))
    rows += [(None, t, draw.choice(roles), draw.choice(texts)) for t in range(40)]
    rows += [(99, t, ("user", "assistant")[t % 2], f"Text {t % 90}.") for t in range(200)]
    rows += [(98, 0, "user", "Same.")] * 30
    return rows


@pytest.mark.parametrize("block", [repair.BLOCK, 3])
def test_repair_equals_a_table_over_prefixes(spark, block):
    rows = _conversations(5)
    df = spark.createDataFrame(rows, CONV).withColumnRenamed("conv_id", "pos").repartition(5)
    got = {r.conv: tuple(r)[1:] for r in repair.summed(repair.repair_conversations(df, conv="pos", block=block)).collect()}
    for conv in {r[0] for r in rows}:
        assert got[conv] == _brute([r[1:] for r in rows if r[0] == conv]), conv


def test_repaired_turns_are_what_was_hashed(spark):
    rows = _conversations(6)
    parts = repair.repair_conversations(spark.createDataFrame(rows, CONV), block=4).orderBy("conv", "pos").collect()
    for conv, own in itertools.groupby(parts, key=lambda r: r.conv):
        own = list(own)
        told = "\n".join(f"{t.role}:{t.text}" for p in own for t in p.repaired)
        assert hashlib.sha256(told.encode()).hexdigest() == own[-1].sha256
        assert all(p.sha256 is None for p in own[:-1]), conv


def test_auction_finds_the_distances_of_small_lattices():
    draw = random.Random(2)
    for _ in range(200):
        codes = bytes(draw.randrange(12) for _ in range(draw.randint(1, 6)))
        names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
        for entry, row in enumerate(repair.distances(codes)):
            for to, cost in enumerate(row):
                if cost is not None:
                    letters, state, found = repair.cheapest(codes, tuple(0 if s == to else None for s in range(4)), entry)
                    assert (state, found) == (to, cost)
                    turns, end = repair.repaired_turns(letters, entry, [names[c & 3] for c in codes], [""] * len(codes))
                    assert end == to and len(letters.replace("I", "")) == len(codes)


def test_damage_and_empty_conversations(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", None)[t % 3], f"Well. Turn {t}!") for c in range(40) for t in range(4)] + [(None, None, "user", None), (77, None, "system", "x")]
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in models.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    shown = lambda v: " " if v is None else str(v)
    for conv in got:
        kept = []
        for c, turn, role, text in rows:
            pick = zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20
            if c == conv and pick:
                text = "" if pick == 1 else shown(text).translate({ord(x): None for x in ".!?"}) if pick == 2 else text
                kept += [(turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
        assert got[conv] == (_brute(kept) if kept else (0, 0, 0, 0, 0, 0, "", models.EMPTY_SHA256))


def test_no_conversations(spark):
    assert repair.repair_conversations(spark.createDataFrame([], CONV)).count() == 0


# whitening --------------------------------------------------------------------------------------------------------


def _whole(vectors):
    size = max(len(v) for v in vectors)
    return [tuple([floor(float(c) * 256) for c in v] + [0] * (size - len(v))) for v in vectors]


def _check_whitened(got, vectors, top=4):
    xs = _whole(list(vectors.values()))
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[v - s / n for v, s in zip(x, sums)] for x in fit])
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    k = min(top, int((values > len(sums) * 2e-16 * values[0]).sum()))
    assert {r.component for r in got} == set(range(1, k + 1))
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        own = [by[i, c + 1] for i in vectors]
        want = [np.dot([v - s / n for v, s in zip(x, sums)], parts[:, c]) / values[c] ** 0.5 for x in xs]
        have = [r.whitened for r in own]
        sign = 1 if np.dot(have, want) > 0 else -1
        assert np.allclose(have, np.multiply(sign, want), atol=1e-6)
        assert abs(own[0].explained - values[c] / values.sum()) < 1e-9
    for i, x in zip(vectors, xs):
        assert by[i, 1].deviation == sum((n * v - s) ** 2 for v, s in zip(x, sums)) and by[i, 1].n == n
    assert max(r.identity_error for r in got) < 1e-6


def test_whitened_vectors_equal_numpy(spark):
    draw = random.Random(4)
    vectors = {i: [draw.gauss(0, 1 + d) + 50 * (d == 2) for d in range(7)] for i in range(200)}
    vectors |= {200 + i: vectors[i % 3] for i in range(40)} | {300: [0.5, -0.25], 301: []}
    rows = [(i, v, -1.0) for i, v in vectors.items()] + [(400, None, 0.0), (401, [1.0, None], 0.0), (402, [float("nan")] * 7, 0.0), (403, [float("-inf")], 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double").repartition(6)
    _check_whitened(whitening.whiten(df).collect(), vectors)


def test_numbers_beyond_64_bits_stay_exact(spark):
    vectors = {i: [1e12 * (i % 5) + i, -3e11 * (i % 7), 1.0] for i in range(12)}
    got = whitening.whiten(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    xs = _whole(list(vectors.values()))
    n, sums = len(set(xs)), [sum(c) for c in zip(*set(xs))]
    for r in got:
        exact = sum((n * v - s) ** 2 for v, s in zip(xs[r.vec_id], sums))
        assert r.deviation == (exact if exact < 1 << 63 else None)
    assert got[0].identity_error < 1e-4


@pytest.mark.parametrize("rows", [[], [(1, [])], [(1, [0.5, 2.0]), (2, [0.5, 2.0])], [(None, None)]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_repeated_and_null_ids_are_answered_one_by_one(spark):
    rows = [(1, [0.0, 1.0]), (1, [2.0, 0.5]), (None, [1.0, 1.0]), (None, [1.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 4}


# hidden Markov model ----------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, score string, train boolean"


def _texts(seed: int, n: int = 150):
    draw = random.Random(seed)
    left, right = [[f"{p}{i}" for i in range(40)] for p in ("Ab", "zu")]
    rows = []
    for i in range(n):
        words = left if draw.random() < 0.5 else right
        rows.append((i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 60)))))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "never seen Ähnlich"), (None, "AB1 ab1"), (5, "ab1"), (5, "ab1"), (1004, "ab1 " * 3000)]
    return [(i, t, "x", None) for i, t in rows]


def _words(text):
    return (text or "").encode().translate(hmm.LOWER).split()


def _chosen(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def test_base_figures_and_likelihoods_equal_plain_loops(spark):
    rows = _texts(1)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    counts = Counter(w for i, t, *_ in rows if _chosen(i) for w in [*_words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    coded, vocabulary = hmm.encode(docs)
    model = hmm.train(coded, vocabulary, rounds=((16, 2),))
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and abs(model.start.sum() - 1) < 1e-9

    by_class = {}
    for w, c in counts.items():
        if w is not None and c * hmm.FREQUENT < total:
            by_class.setdefault(hmm.word_class(w), []).append(c)

    def probability(text):
        state, out = model.start, 0.0
        for w in [*_words(text), None]:
            c = counts[w]
            if w is None:
                symbol, share = 0, 1.0
            elif c * hmm.FREQUENT >= total:
                key = np.uint64(hmm.xxhash.xxh3_64_intdigest(w)).view(np.int64)
                symbol, share = 1 + vocabulary.frequent.tolist().index(key), 1.0
            else:
                own = by_class.get(hmm.word_class(w), [])
                symbol, share = 1 + len(vocabulary.frequent) + hmm.word_class(w), (c + 1) / (sum(own) + len(own) + 1)
            state = state * model.emit[symbol]
            out += log10(state.sum() * share)
            state = (state / state.sum()) @ model.move
        return out

    got = sorted(hmm.score_texts(docs, rounds=((16, 2),)).collect(), key=str)
    want = []
    for i, t, *_ in rows:
        words = [*_words(t), None]
        base = sum(log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        want.append((i, not _chosen(i), len(words), sum(counts[w] > 0 for w in words), total, base, probability(t)))
    by_row = lambda r: (str(r[0]), r[2], r[3])
    for have, wanted in zip(sorted((tuple(r) for r in got), key=by_row), sorted(want, key=by_row), strict=True):
        assert have[:5] == wanted[:5]
        assert have[5:] == pytest.approx(wanted[5:], rel=1e-6)


def test_expected_counts_equal_all_state_paths():
    draw = np.random.default_rng(3)
    states, symbols = 3, 5
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Model(norm(draw.random(states), 0), norm(draw.random((states, states)), 1), norm(draw.random((symbols, states)), 0), norm(draw.random(states), 0))
    sequences = [draw.integers(0, symbols, n) for n in (4, 1, 3, 4)]
    begins = np.array([True, True, False, True])
    counts = hmm.Counts(states, symbols)
    hmm.expect(model, sequences, begins, counts)
    want, likely = hmm.Counts(states, symbols), []
    for s, first in zip(sequences, begins):
        paths = {}
        for path in itertools.product(range(states), repeat=len(s)):
            p = (model.start if first else model.shares)[path[0]] * model.emit[s[0], path[0]]
            for a, b, y in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[y, b]
            paths[path] = p
        total = sum(paths.values())
        likely.append(total)
        for path, p in paths.items():
            p /= total
            want.start[path[0]] += p * first
            for a, b in itertools.pairwise(path):
                want.move[a, b] += p
            for k, y in zip(path, s):
                want.emit[y, k] += p
    assert np.allclose(counts.rows(), want.rows())
    own = [i for i, b in enumerate(begins) if b]
    assert np.allclose(hmm.likelihoods(model, [sequences[i] for i in own]), np.log10([likely[i] for i in own]))


def test_chunks_and_slices_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame(_texts(2), DOCS).repartition(3)
    whole = sorted((tuple(r)[:5] for r in hmm.score_texts(docs, rounds=((16, 1),)).collect()), key=str)
    assert whole == sorted((tuple(r)[:5] for r in hmm.score_texts(docs.coalesce(1), rounds=((16, 1),)).collect()), key=str)
    monkeypatch.setattr(hmm, "SLICE", 64)
    text = b"ab  cd\n" * 200 + b"x" * 300 + b" y"
    assert b"".join(hmm.pieces(text)) == text and [w for p in hmm.pieces(text) for w in p.split()] == text.split()


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    rows = hmm.score_texts(spark.createDataFrame(_texts(3, 400), DOCS).repartition(4)).filter("held_out and n_tokens > 5").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.95


def test_empty_and_untaught_tables(spark):
    assert hmm.score_texts(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(100) if not _chosen(i))
    row = hmm.score_texts(spark.createDataFrame([(held, "a b", "", None)], DOCS)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score < 0
