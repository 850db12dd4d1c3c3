"""Url rules, sharding, chat formatting and mixing: brute force, laws, edge cases, and plans without Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetscope.llm import chat, mixing, sharding, url_rules
from fleetscope.llm.queries import ORACLES, QUERIES
from tests.llm.brute import DOC_SCHEMA
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", ["op6_mixing", "op7_url_rules", "op8_sharding", "op10_chat"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct") if w in plan]


# urls -------------------------------------------------------------------------------------------------------------


def _parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    path = rest[end:]
    end2 = min([path.find(c) for c in "?#" if c in path] + [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:end2]


def _judge(url, rules):
    host, path = _parse(url)
    fits = [(len(h) + len(p), len(h), a, h + p) for h, p, a in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_rules_equal_brute_force(spark):
    draw = random.Random(5)
    labels, parts = ["a", "b", "ab", "com", "org"], ["", "/", "/x", "/x/", "/x/y", "/xy", "/é"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
    rules = [(host(), draw.choice(parts), draw.choice(["allow", "block"])) for _ in range(60)] + [("", "/x/y", "block"), (None, None, "allow")]
    urls = [f"{draw.choice(['http', 'https'])}://{host().upper() if draw.random() < 0.2 else host()}{draw.choice(parts)}{draw.choice(['', 'z', '?q=/x', '#x'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http://?x", "http://a..b/x", "x://a/b://c", urls[0], urls[0]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"rule": F.lit(1), "key": F.lit(2)})
    table = spark.createDataFrame(rules, "host string, path string, action string")
    clean = sorted({(h or "", p or "", a) for h, p, a in rules})
    clean = [r for r in clean if r[2] == "block" or (r[0], r[1], "block") not in clean]
    got = url_rules.apply_url_rules(pages, table).collect()
    want = {n: _judge(u, clean) for n, u in enumerate(urls)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want and len(got) == len(urls)


def test_urls_without_rules_or_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.apply_url_rules(pages, rules, "block").select("rule", "verdict").collect()] == [(None, "block")]
    assert url_rules.apply_url_rules(pages.limit(0), rules).count() == 0


# shards -----------------------------------------------------------------------------------------------------------


def _laws(rows, shards, slack):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    size = lambda r: len((r.text or "").encode()) + 1
    total = sum(map(size, rows))
    most = max(map(size, rows), default=0)
    for k in range(shards):
        assert sorted(r.slot for r in by[k]) == list(range(len(by[k])))
        assert abs(sum(map(size, by[k])) - total / shards) <= slack * total / shards + 2 * most
    assert set(by) <= set(range(shards))


def test_shards_are_even_and_groups_stay_together(spark):
    draw = random.Random(7)
    rows = [(n, "x" * draw.randint(0, 50) + str(n % 900), "en", "s", 1) for n in range(3000)] + [(9000, None, None, None, None), (None, "y", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    got = sharding.shard_by_bytes(docs, 8).collect()
    assert len(got) == len(rows)
    _laws(got, 8, 0.01)


def test_one_group_with_half_of_all_rows_is_split(spark):
    rows = [(n, "same text" if n % 2 else f"text {n}", "en", "s", 9) for n in range(4000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, DOC_SCHEMA), 8).collect()
    _laws(got, 8, 0.01)
    assert len({r.shard for r in got if r.text == "same text"}) > 1


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1)] * 20, [(-(1 << 63), "a", "en", "s", 1), ((1 << 63) - 1, "a", "en", "s", 1)]])
def test_few_or_repeated_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("slot", F.lit("clash"))
    got = sharding.shard_by_bytes(docs, 4).collect()
    assert len(got) == len(rows)
    for k in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own)))


def test_tables_of_other_partitionings_shard_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = (sorted((r.doc_id, r.shard) for r in sharding.shard_by_bytes(d, 8).collect()) for d in (docs, docs.repartition(7, "source")))
    assert first == second


# chats ------------------------------------------------------------------------------------------------------------

HARD = ["", "</turn>", "<next>", "<turn user>", "\\", "\\l", "\\b", "\\\\l<", "a\\", "<", ">", "\\g>", "\n", "é😀<", "\\### Assistant: </turn> ok", "x" * 5000]


def test_chats_read_back_as_they_were(spark):
    draw = random.Random(9)
    rows = [(c, t, draw.choice(["user", "assistant", "assistant", "system", "a>b", "", None]), draw.choice([*HARD, None])) for c in range(60) for t in range(draw.randint(1, 9))]
    rows += [(None, 1, "user", "x"), (99, None, "assistant", "first"), (99, 3, "assistant", "b"), (99, 3, "assistant", "b"), (99, 3, "assistant", "a")]
    shuffled = draw.sample(rows, len(rows))
    out = chat.format_chats(spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    got = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("lost"), "loss").collect()
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert len(got) == len(want)
    for r in got:
        turns = [(role, x) for _, _, role, x in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.lost == "".join(x for role, x in turns if role == "assistant")
        blocks = [n for n, t in enumerate(turns) if n == 0 or turns[n - 1][0] != t[0]]
        assert r.formatted.count("</turn>") == r.formatted.count("<turn ") == len(blocks)
        assert all(chat.CLOSE not in r.formatted[s.start : s.start + s.chars] for s in r.loss)


def test_no_conversations(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# mixing -----------------------------------------------------------------------------------------------------------


def _fit(cells, targets, rounds=200):
    weight = {c: t / sum(cells.values()) for c, t in cells.items()}
    for _ in range(rounds):
        for k, wanted in enumerate(targets):
            there = {c[k] for c in cells}
            total = sum(v for x, v in wanted.items() if x in there)
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[k]] += w
            weight = {c: w * wanted.get(c[k], 0) / total / sums[c[k]] if sums[c[k]] else 0.0 for c, w in weight.items()}
    return weight


def test_raking_equals_brute_force(spark):
    draw = random.Random(11)
    cells = {(s, g, t): draw.randint(1, 1000) for s in "abcd" for g in ("x", "y", "(null)") for t in "pq" if draw.random() < 0.8}
    targets = [{"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1, "gone": 0.5}, {"x": 0.5, "y": 0.25, "(null)": 0.25}, {"p": 0.7, "q": 0.3}]
    table = spark.createDataFrame([(*c, n) for c, n in cells.items()], "s string, g string, t string, tokens long")
    aims = {m: spark.createDataFrame(list(t.items()), "value string, share double") for m, t in zip("sgt", targets)}
    got = {(r.s, r.g, r.t): r.weight for r in mixing.rake(table, aims, tolerance=1e-9).collect()}
    want = _fit(cells, targets)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-7 for c in want)


def _mixed(spark, rows, **more):
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("probability", F.lit("clash"))
    return mixing.mix_to_targets(docs, {"source": F.col("source"), "lang": F.col("lang")}, F.col("n_chars"), **more).collect()


def test_probabilities_meet_the_targets(spark):
    draw = random.Random(13)
    rows = [(n, "t", draw.choice(["en", "de", None]), draw.choice(["s", "s", "s", "u", "v"]), draw.randint(0, 100)) for n in range(3000)]
    got = _mixed(spark, rows, powers={"source": 0.5, "lang": 0.5})
    expected, drawn, size = defaultdict(float), defaultdict(float), defaultdict(float)
    for r in got:
        size[r.source] += r.tokens
        expected[r.source] += r.tokens * r.probability
        drawn[r.source] += r.tokens * r.copies
        assert 0 <= r.probability <= 1 + 1e-9 and r.copies in (0, 1)
    root = {s: n**0.5 for s, n in size.items()}
    for s in size:
        share = root[s] / sum(root.values())
        assert abs(expected[s] / sum(expected.values()) - share) < 1e-4
        assert abs(drawn[s] / sum(drawn.values()) - share) < 0.05
    assert max(r.probability for r in got) > 0.999


def test_a_budget_above_the_data_gives_copies(spark):
    rows = [(n, "t", "en", "s", 10) for n in range(500)]
    got = _mixed(spark, rows, budget=5000 * 2.5)
    assert {r.copies for r in got} == {2, 3} and abs(sum(r.copies for r in got) / 500 - 2.5) < 0.1


def test_a_budget_may_be_a_share_of_the_tokens(spark):
    rows = [(n, "t", "en", "s" if n else "stray", 10) for n in range(500)]
    got = _mixed(spark, rows, powers={"source": 0.5}, budget_share=0.5)
    assert abs(sum(r.probability * r.tokens for r in got) - 2500) < 0.1
    with pytest.raises(ValueError):
        _mixed(spark, rows, budget=1.0, budget_share=1.0)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "t", "en", "s", 0)] * 3])
def test_mixing_without_tokens(spark, rows):
    got = _mixed(spark, rows)
    assert len(got) == len(rows) and {r.copies for r in got} <= {0, 1}
