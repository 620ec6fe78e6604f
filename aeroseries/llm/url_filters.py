"""Allow and block rules on URLs by a sort-merge range join.

A host is written with its labels reversed, each followed by a full stop, so that a host and its subdomains form one
interval of the sorted keys. The ends of the rules' intervals cut the key space into segments; each segment carries the
stack of the nested rules that are active in it. URLs and segments are sorted together, and one sweep hands every URL the
stack of the segment it lies in. Of the stacked rules those whose path starts the URL's path fit, and the longest wins.

The sweep runs in cells of a top-level label and a salt. The segments of a label are laid into each of its cells, so a label
or host with a third of all rows is spread over all of them; nothing is broadcast, and the sort can spill.

Defined cases: a null URL or one without ``://`` has an empty host and path, and no rule fits; rules with a null or empty
host fit nothing; of rules equally long the one that sorts first wins; repeated rules count once; rows are never merged, so
repeated ids stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rule rows that may be laid out over all salts together.
MAX_RULE_ROWS = 20_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels of a host from the last to the first, each followed by a full stop."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _interval_end() -> Column:
    """The first key behind all that start with the column ``key``: a solidus is the character after the full stop."""
    return F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/"))


def segments(rules: DataFrame) -> DataFrame:
    """Rows (key, kind, stack): from ``key`` on, the rules in ``stack`` are active. ``rules`` has host, path and verdict."""
    named = rules.filter(F.coalesce("host", F.lit("")) != "").select(
        host_key(F.translate("host", _UPPER, _LOWER)).alias("key"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"),
        "verdict",
    )
    own = named.distinct().select(
        "key", F.struct((-F.length("rule")).alias("rank"), "rule", "path", "verdict").alias("entry")
    )
    hosts = own.select("key").distinct()
    labels = F.split("key", "\\.")
    depth = F.size(labels) - 1
    prefixes = hosts.select(
        "key", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))).alias("stem")
    ).select("key", F.concat("stem", F.lit(".")).alias("stem"))
    stacked = prefixes.join(own.withColumnRenamed("key", "stem"), "stem")
    stacks = stacked.groupBy("key").agg(
        F.sort_array(F.collect_list("entry")).alias("inside"),
        F.sort_array(F.collect_list(F.when(F.col("stem") != F.col("key"), F.col("entry")))).alias("outside"),
    )
    opened = stacks.select("key", F.lit(1).alias("kind"), F.col("inside").alias("stack"))
    return opened.union(stacks.select(_interval_end(), F.lit(0), "outside"))


def judge(
    pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for every page."""
    spark = pages.sparkSession
    steps = segments(rules)
    n_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(8 * n_partitions, MAX_RULE_ROWS // (2 * rules.count() + 1)))
    address = F.col(url).cast("string")
    named = pages.select(F.col(page_id).alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"))
    keyed = named.select(
        "page_id", "host", "path", host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"),
        F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).cast("int").alias("salt"),
    )
    laid = steps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = keyed.unionByName(laid, allowMissingColumns=True).withColumn("label", F.substring_index("key", ".", 1))
    # The end of a top-level label's own interval lies behind all URLs of that label, in whose cells it is not needed.
    sweep = Window.partitionBy("label", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 2")
    fits = F.filter("active", lambda entry: F.startswith(F.col("path"), entry["path"]))
    chosen = swept.withColumn("best", F.get(fits, F.lit(0)))
    return chosen.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
