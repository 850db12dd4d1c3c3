"""Host and path rules as intervals of a sorted key, found by one sweep over rules and urls together.

A rule (host, path) fits its host and all subdomains when the url's path begins with the rule's. The key of a rule is its
host with the labels reversed, then its path: everything that begins with the key is one interval of the sort order. A url
asks with one key for each of its host's parents (and the host itself), so each answer is a prefix. Rules and asked keys
are sorted together; at each point the stack of enclosing rules is that of the last rule passed, and the deepest one that
still holds the key is the answer. The longest answer over the parents wins, at equal length the longer host, then block.

Blocks of the sweep are ranges of (key, host, path), so a host with a third of all urls spans many tasks. Equal
(host, path) pairs ask once.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the verdict for
urls without a rule. Null parts of a rule are empty; an empty rule host fits every host. Repeated rules count once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.llm.common import partitions, stored

END = "\x01"  # between the reversed host and the path in a key


def url_host(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _parents(host: Column) -> Column:
    """Reversed keys of the host and all its parents, the empty one first: ``a.b`` gives ``''``, ``b.``, ``b.a.``."""
    labels = F.reverse(F.split(host, r"\."))
    joined = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    return F.when(host == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), joined))


def _rule_table(rules: DataFrame) -> DataFrame:
    """``key, stack``: the rules that enclose each rule's key and the rule itself, longest key first."""
    empty = F.lit("")
    clean = rules.select(F.coalesce("host", empty).alias("host"), F.coalesce("path", empty).alias("path"), "action").distinct()
    keyed = clean.select(F.concat(F.element_at(_parents(F.col("host")), -1), F.lit(END), "path").alias("key"), "host", "path", "action")
    one = keyed.groupBy("key").agg(F.max(F.struct("action", "host", "path")).alias("r")).select("key", "r.*")
    starts = F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
    own = one.select(F.col("key").alias("_of"), F.explode(starts).alias("key"))
    around = own.join(one, "key").groupBy("_of").agg(F.collect_list(F.struct(F.length("key").alias("n"), "key", "host", "path", "action")).alias("stack"))
    return around.select(F.col("_of").alias("key"), F.sort_array("stack", asc=False).alias("stack"))


def apply_url_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", url_column: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule`` (host and path of the rule that decides, else null) and ``verdict``.

    ``rules`` has ``host, path, action``.
    """
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    urls = pages.withColumns({"host": url_host(F.col(url_column)), "path": url_path(F.col(url_column))})
    asked = urls.select("host", "path").distinct().withColumn("_parent", F.explode(_parents(F.col("host"))))
    asked = asked.select(F.concat("_parent", F.lit(END), "path").alias("key"), F.lit(1).alias("kind"), "host", "path")
    both = asked.unionByName(_rule_table(rules).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ranged = both.repartitionByRange(2 * partitions(spark), "key", "kind", "host", "path").withColumn("block", F.spark_partition_id())
    ranged = stored(ranged, "url-sweep")

    sweep = W.partitionBy("block").orderBy("key", "kind")
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = ranged.groupBy("block").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("_last"))
    carried = ends.select("block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    last = F.last("stack", ignorenulls=True).over(sweep.rowsBetween(W.unboundedPreceding, 0))
    swept = ranged.withColumn("_stack", last).filter("kind = 1").join(carried, "block", "left")
    active = F.coalesce("_stack", "_carried")
    swept = swept.withColumn("_hit", F.get(F.filter(active, lambda r: F.col("key").startswith(r["key"])), F.lit(0))).filter("_hit is not null")
    rank = F.struct(
        (F.length("_hit.host") + F.length("_hit.path")).alias("n"), F.length("_hit.host").alias("h"), F.col("_hit.action").alias("action"),
        F.concat("_hit.host", "_hit.path").alias("rule"),
    )
    best = swept.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    judged = urls.join(best, ["host", "path"], "left")
    return judged.select(*pages.columns, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))
