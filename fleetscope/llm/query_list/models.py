"""Queries of the operators that repair conversations, whiten vectors and score texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import conversation_repair, hidden_markov, whitening

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults that the checksum of conversation and turn picks."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), pick.alias("_pick")).filter("_pick <> 0")
    text = F.when(F.col("_pick") == 1, "").when(F.col("_pick") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    marked = marked.withColumns({"text": text, "role": F.when(F.col("_pick") == 4, "user").otherwise(F.col("role"))})
    return marked.withColumn("_pick", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_pick") == 3, 2).otherwise(1)))).drop("_pick")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = conversation_repair.summed(conversation_repair.repair_conversations(damaged(rows)))
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


def _best(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _step(way: str, cost: str, letter: str, line: str = "[]::varchar[]") -> str:
    return f"{{'c': {way}.c + {cost}, 's': {way}.s || '{letter}', 'r': list_concat({way}.r, {line})}}"


def _inserted(n: str, s: str, u: str, a: str) -> tuple[str, str]:
    """Best ways that end in a user and in an assistant turn, once turns may be inserted."""
    user, assistant = "['user:']", "['assistant:']"
    to_user = _best(u, *(_step(w, "5", "I", user) for w in (n, s, a)))
    to_assistant = _best(a, _step(u, "5", "I", assistant), *(_step(w, "10", "II", "['user:', 'assistant:']") for w in (n, s)))
    return to_user, to_assistant


def _op11_sql() -> str:
    keep, rename = "case when f = 2 then 5 else 0 end + case when f = 1 then 1000000 else 0 end", "1 + case when f = 2 then 5 else 0 end + case when f = 1 then 1000000 else 0 end"
    only = lambda initial: f"{keep} + case when role[1] = '{initial}' then 0 else 1000000 end"
    kept, as_user, as_assistant = "[role || ':' || txt]", "['user:' || txt]", "['assistant:' || txt]"
    next_n = _step("n", "2", "D")
    next_s = _best(_step("s", "2", "D"), _step("n", only("s"), "K", kept))
    to_user = [o for w in ("n", "s", "a2") for o in (_step(w, only("u"), "K", kept), _step(w, rename, "R", as_user))]
    next_u = _best(_step("u2", "2", "D"), *to_user)
    next_a = _best(_step("a2", "2", "D"), _step("u2", only("a"), "K", kept), _step("u2", rename, "R", as_assistant))
    u2, a2 = _inserted("n", "s", "u", "a")
    return rf"""
with recursive src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') txt,
  coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
picked as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x // 2, 3988292384 * (x % 2)))), 4294967295) % 20 d from src),
damaged as (select conv_id, turn, case when d = 4 then 'user' else role end as role,
  case d when 1 then '' when 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end txt, unnest(range(case when d = 3 then 2 else 1 end)) from picked where d <> 0),
placed as (select conv_id, turn, role, txt, row_number() over (partition by conv_id order by turn nulls first, role, substr(txt, 1, 64), md5(role || chr(1) || txt)) k from damaged),
judged as (select *, rtrim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) solid, row_number() over (partition by conv_id, role, txt order by k) nth,
  lag(role) over (partition by conv_id order by k) as prev from placed),
faulty as (select *, case when solid = '' then 'b' when nth > 1 then 'd' when right(solid, 1) not in ('.', '!', '?') then 't' else '' end fault from judged),
lines as (select *, case fault when '' then 0 when 't' then 2 else 1 end f from faulty),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate,
  count(*) filter (fault = 't') truncated, count(*) filter (prev is not null and prev[1] || role[1] not in ('su', 'ua', 'au')) illegal, count(*) last from lines group by conv_id),
way as (select distinct conv_id, 0::bigint k, {{'c': 0::bigint, 's': '', 'r': []::varchar[]}} n, {{'c': 1000000000::bigint, 's': '', 'r': []::varchar[]}} s,
  {{'c': 1000000000::bigint, 's': '', 'r': []::varchar[]}} u, {{'c': 1000000000::bigint, 's': '', 'r': []::varchar[]}} a from lines
 union all
 select conv_id, k, {next_n}, {next_s}, {next_u}, {next_a}
 from (select l.conv_id, l.k, l.role, l.txt, l.f, n, s, {u2} u2, {a2} a2 from way w join lines l on w.conv_id is not distinct from l.conv_id and l.k = w.k + 1)),
done as (select w.conv_id, {_best("n", "a", _step("u", "5", "I", "['assistant:']"), _step("s", "10", "II", "['user:', 'assistant:']"))} best
 from way w join counts c on w.conv_id is not distinct from c.conv_id and w.k = c.last)
select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
 coalesce(illegal, 0) illegal, coalesce(best.c, 0) as cost, coalesce(best.s, '') audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id
left join done d on o.conv_id is not distinct from d.conv_id
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair, "op12_whitening": op12_whitening, "op13_hidden_markov": op13_hidden_markov}
ORACLES = {"op11_conversation_repair": _op11_sql()}
