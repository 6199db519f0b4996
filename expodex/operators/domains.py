"""Registered domains by a table of public suffix rules.

A rule is a suffix (`co.uk`), a wildcard (`*.ck`: any one label before ck) or an exception to one (`!www.ck`).
The labels of a host are looked up from the right: each of its suffixes is joined to the rules with that suffix, which is
what a walk down a trie of reversed labels does. An exception decides, else the longest rule, else the last label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D


def default_rules(spark) -> DataFrame:
    """(rule): the suffixes of two labels that the engine knows; all others have one label."""
    return spark.createDataFrame([(s,) for s in D.TWO_LABEL_SUFFIXES], "rule string")


def suffix_rules(spark, path: str) -> DataFrame:
    """(rule) from a text file of one rule a line; blank lines and comments (//) are none, and what follows a space does not count."""
    line = F.regexp_extract("value", r"^\s*(\S*)", 1)
    return spark.read.text(path).select(F.lower(line).alias("rule")).filter("rule <> '' and not startswith(rule, '//')")


def registered_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host) and (rule) -> host, suffix, registered for every distinct host that is not null.

    registered: the public suffix and one label more; NULL if the host is a suffix itself or empty. An address of
    numbers is returned whole. A port, a final dot and upper case do not matter; `suffix` is NULL for addresses.
    """
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim("host")), r":\d+$", ""), r"\.+$", "")
    names = hosts.select("host").filter("host is not null").distinct().withColumn("name", clean)
    number = F.col("name").rlike(r"^\d+(\.\d+){3}$") | F.col("name").startswith("[")
    labels = F.split("name", r"\.")
    held = names.withColumn("labels", F.when(number | (F.col("name") == ""), F.array().cast("array<string>")).otherwise(labels))
    known = rules.select(F.lower(F.trim("rule")).alias("rule")).filter("rule <> ''").distinct()
    star, bang = F.col("rule").startswith("*."), F.col("rule").startswith("!")
    length = F.size(F.split("rule", r"\."))
    known = known.select(F.when(star, F.substring("rule", 3, 1 << 20)).when(bang, F.substring("rule", 2, 1 << 20)).otherwise(F.col("rule")).alias("key"), F.when(bang, length - 1).otherwise(length).alias("n"), bang.alias("exception"))
    each = held.filter("size(labels) > 0").select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"))
    each = each.select("host", F.size("labels").alias("size"), F.array_join(F.slice("labels", -F.col("k"), F.col("k")), ".").alias("key"))
    best = each.join(known, "key").filter("n <= size").groupBy("host").agg(F.max(F.struct("exception", "n")).alias("b"))
    out = held.join(best, "host", "left").withColumn("n", F.coalesce("b.n", F.lit(1)))
    last = lambda n: F.when(F.size("labels") >= n, F.array_join(F.slice("labels", -n, n), "."))
    some = F.size("labels") > 0
    return out.select("host", F.when(some, last(F.col("n"))).alias("suffix"), F.when(some, last(F.col("n") + 1)).when(F.col("name") != "", F.col("name")).alias("registered"))
