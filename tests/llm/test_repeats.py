"""Suffix-order dedup and the Jaccard join against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fleetscope.llm import jaccard_join, suffix_dedup
from fleetscope.llm.components import components
from tests.llm import brute


def _docs(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def _vocabulary(seed: int, n: int = 400) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("aeioutnsrh") for _ in range(draw.randint(2, 8))) for _ in range(n)]


def _corpus(seed: int) -> list[tuple[int | None, str | None]]:
    """Originals, exact and near copies, shared passages, repeated lines, edge cases."""
    draw, words = random.Random(seed), _vocabulary(seed)
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage = prose(60)
    rows: list[tuple[int | None, str | None]] = [(n, prose(draw.randint(5, 200))) for n in range(60)]
    for n in range(60, 90):
        rows.append((n, rows[draw.randrange(60)][1]))
    for n in range(90, 130):
        own = rows[draw.randrange(60)][1].split()
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((n, " ".join(own)))
    rows += [(n, f"{prose(30)} {passage} {prose(30)}") for n in range(130, 150)]
    rows += [(150, None), (151, ""), (152, "a"), (153, "ha " * 500), (154, "ha " * 300), (155, "é" * 80), (156, "xé" + "é" * 80), (None, passage), (157, "\n" * 60 + passage)]
    return rows


@pytest.mark.parametrize("hot", [256, 1])
def test_removes_what_earlier_documents_hold(spark, hot):
    rows = _corpus(1)
    got = {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.removed)) for r in suffix_dedup.remove_repeats(_docs(spark, rows), block_bytes=4000, hot_blocks=hot).collect()}
    assert got == brute.cut_repeats(rows)


def test_repeated_ids_never_cut_each_other(spark):
    text = "the same words again and again, long enough to count as a passage of fifty bytes"
    rows = [(5, text), (5, text), (7, text)]
    got = sorted((r.doc_id, len(r.kept)) for r in suffix_dedup.remove_repeats(_docs(spark, rows)).collect())
    assert got == [(5, len(text)), (5, len(text)), (7, 0)]


def test_empty_table_has_no_cuts(spark):
    assert suffix_dedup.remove_repeats(_docs(spark, [])).count() == 0


def test_previous_factors_equal_brute_force():
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randint(50, 70))).encode() for _ in range(25)]
    texts += [t[1:] + b"b" for t in texts[:12]] + [b"\0" * 55, b"a" + b"\0" * 55, texts[0][:50], b"x" * 80]
    texts = [t for t in dict.fromkeys(texts) if len(t) >= 50]
    firsts = np.array([draw.choice([-(1 << 63), *range(20)]) for _ in texts])
    longest, holder, counts = suffix_dedup.previous_factors(texts, firsts)
    at = 0
    for t, d, n in zip(texts, firsts.tolist(), counts.tolist()):
        assert n == len(t) - 49
        for p in range(n):
            best = 0
            for o, e in zip(texts, firsts.tolist()):
                for q in range(len(o) - 49) if e < d else ():
                    k = 0
                    while p + k < len(t) and q + k < len(o) and t[p + k] == o[q + k]:
                        k += 1
                    best = max(best, k)
            assert longest[at] == best and (best == 0 or holder[at] < d)
            at += 1
    for t, d, docs in zip(texts, firsts.tolist(), suffix_dedup.earlier_documents(texts, firsts)):
        held = [any(e < d and t[p : p + 50] in o for o, e in zip(texts, firsts.tolist())) for p in range(len(t) - 49)]
        assert (docs < d).tolist() == held


@pytest.mark.parametrize("leaf", [256, 4])
def test_links_and_classes_equal_brute_force(spark, leaf):
    rows = _corpus(2)
    rows += [(n, rows[0][1] + f" w{n % 7}") for n in range(200, 225)]  # a group larger than a small leaf
    rows += [(300, rows[3][1]), (300, rows[3][1]), (301, rows[4][1]), (301, rows[5][1])]  # repeated rows, one id for two texts
    got = jaccard_join.near_duplicates(_docs(spark, rows), leaf=leaf).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *[str(x) for x in r[1:]])
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=key) == sorted(brute.similar(rows), key=key)


def test_every_class_keeps_a_row(spark):
    rows = _corpus(4)
    got = jaccard_join.near_duplicates(_docs(spark, rows)).collect()
    keepers = {(r.doc_id, r.class_id) for r in got if r.first}
    assert all(d == c for d, c in keepers)
    assert {c for _, c in keepers} == {r.class_id for r in got}


def test_no_documents_no_links(spark):
    assert jaccard_join.near_duplicates(_docs(spark, [])).count() == 0
    assert jaccard_join.near_duplicates(_docs(spark, [(1, None), (2, "")])).filter("n_links > 0").count() == 0


def test_runs_reach_the_recall():
    runs = jaccard_join.runs_for(0.999, 0.8, 3)
    assert 1 - (1 - 0.8**3) ** runs >= 0.999 > 1 - (1 - 0.8**3) ** (runs - 1)


def test_whole_table_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == sorted(brute.similar(rows))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 201)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 103: 100, 105: 100, 200: 200, 201: 200}


def test_many_rows_without_an_id_are_compared_as_with_ids(spark):
    words, draw = _vocabulary(9), random.Random(9)
    rows = []
    for i in range(2500):
        own = [draw.choice(words) for _ in range(60)]
        rows += [(None, " ".join(own)), (None if i % 2 else 3, " ".join([*own[:-1], "other"]))]
    got = jaccard_join.near_duplicates(_docs(spark, rows)).collect()
    assert len(got) == 5000 and all(r.n_links == 1 for r in got)
    assert all(r.class_id is None for r in got) and sum(r.first for r in got) == 2500
