"""Crawl policies: what an origin's answer means, and whether a URL may be fetched. Fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import origin_of


def origin_policy(status: Column) -> Column:
    return (
        F.when(status == 200, "rules_applied")
        .when(status.isin(401, 403), "disallow_all")
        .when(status.between(400, 499), "allow_all_no_policy")
        .otherwise("temporarily_unavailable_defer_crawl")
    )


def parse_rules(bodies: DataFrame) -> DataFrame:
    """(origin, agent, line_no, allow, prefix) of policy files (origin, body).

    Agents named one after another share the rules below them. A disallow line without a path allows everything.
    """
    line = F.posexplode(F.split("body", "\r?\n")).alias("line_no", "line")
    lines = bodies.select("origin", line).withColumn("line", F.trim(F.split_part("line", F.lit("#"), F.lit(1))))
    key, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    lines = lines.where(F.contains("line", F.lit(":"))).select("origin", "line_no", key.alias("key"), value.alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow"))
    by = Window.partitionBy("origin").orderBy("line_no")
    agent = F.col("key") == "user-agent"
    opens = agent & ~F.coalesce(F.lag("key").over(by) == "user-agent", F.lit(False))
    grouped = lines.withColumn("block", F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where(agent).select("origin", "block", F.lower("value").alias("agent")).distinct()
    rules = grouped.where(~agent & (F.col("block") > 0))
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    return rules.join(agents, ["origin", "block"]).select("origin", "agent", "line_no", allow.alias("allow"), F.col("value").alias("prefix"))


def admit(urls: DataFrame, origins: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """urls (url) with `admission`: allowed, disallowed or unavailable.

    origins: (origin, policy, has_body). The agent's own rules count, or those for * where it has
    none; the first whose path the URL's path starts with decides, and none means allowed. A star in a path is a plain character.
    """
    named = urls.withColumn("__origin", origin_of(F.col("url")))
    rest = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$", "")
    named = named.withColumn("__path", F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))
    own = rules.where((F.col("agent") == "*") | F.contains(F.lit(agent.lower()), F.col("agent")))
    special = own.groupBy("origin").agg(F.bool_or(F.col("agent") != "*").alias("__special"))
    own = own.join(special, "origin").where(F.when(F.col("__special"), F.col("agent") != "*").otherwise(True)).select(F.col("origin").alias("__o"), "line_no", "allow", "prefix")
    # The first rule of each prefix; URLs meet it by their own first letters, as many as the origin's prefixes have.
    by_prefix = own.groupBy("__o", "prefix").agg(F.min_by("allow", "line_no").alias("allow"), F.min("line_no").alias("line_no"))
    lengths = by_prefix.groupBy(F.col("__o").alias("__origin")).agg(F.collect_set(F.char_length("prefix")).alias("__lengths"))
    cut = named.select("url", "__origin", "__path").distinct().join(lengths, "__origin")
    cut = cut.select("url", "__origin", "__path", F.explode(F.filter("__lengths", lambda n: n <= F.char_length("__path"))).alias("__n"))
    cut = cut.select("url", F.col("__origin").alias("__o"), F.substring("__path", F.lit(1), F.col("__n")).alias("prefix"))
    first = cut.join(by_prefix, ["__o", "prefix"]).groupBy("url").agg(F.min_by("allow", "line_no").alias("__allow"))
    known = origins.select(F.col("origin").alias("__known"), "policy", "has_body")
    joined = named.join(known, F.col("__origin") == F.col("__known"), "left").join(first, "url", "left")
    verdict = (
        F.when(F.col("__known").isNull(), "unavailable")
        .when(F.col("policy") == "allow_all_no_policy", "allowed")
        .when(F.col("policy") != "rules_applied", "disallowed")
        .when(~F.col("has_body"), "unavailable")
        .when(F.coalesce("__allow", F.lit(True)), "allowed")
        .otherwise("disallowed")
    )
    return joined.select(*(F.col(c) for c in urls.columns), verdict.alias("admission"))


def audit(admitted: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(origin, checked, allowed, compliant) of admit()'s rows; with origins (origin, policy, status) also their policy and status, null where unknown."""
    ok = F.col("admission") == "allowed"
    found = admitted.groupBy(origin_of(F.col("url")).alias("origin")).agg(F.count("*").alias("checked"), F.count_if(ok).alias("allowed"), F.bool_and(ok).alias("compliant"))
    return found if origins is None else found.join(origins.select("origin", "policy", "status"), "origin", "left")


def exceptions(admitted: DataFrame) -> DataFrame:
    """(url, origin, admission) of the distinct URLs that must not be fetched as things are."""
    return admitted.where("admission <> 'allowed'").select("url", origin_of(F.col("url")).alias("origin"), "admission").distinct()


def deferred(admitted: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, policy, urls) of origins whose crawl waits: those that gave no usable answer, or are not known; urls: how many distinct ones wait."""
    waits = (F.col("policy") == "temporarily_unavailable_defer_crawl") | F.col("policy").isNull()
    asked = admitted.select(origin_of(F.col("url")).alias("origin"), "url").distinct().groupBy("origin").agg(F.count("*").alias("urls"))
    return asked.join(origins.select("origin", "policy"), "origin", "left").where(waits).select("origin", "policy", "urls")
