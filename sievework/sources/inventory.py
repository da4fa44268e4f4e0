"""Inventories of sources, discovery rules made from them, and hierarchy files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..functions.urls import parser_family
from ..operators.classify import DEFAULTS, default_rule
from ..operators.quality import inventory_report, require_inventory

HIERARCHY = ("school_slug", "school", "department_slug", "department", "source_url")


def read_inventory(
    spark: SparkSession, path: str, required: Sequence[str], n_rows: int | None = None, slug: str = "chair_name", url: str = "project_study_url", department: str = "department", departments: Sequence[str] | None = None
) -> DataFrame:
    """A JSON array of records. With n_rows the records must be so many, with exactly the required keys and unique names and urls; with departments, of exactly these."""
    rows = spark.read.option("multiLine", True).json(path)
    if n_rows is not None:
        require_inventory(inventory_report(rows, slug, url, department if department in rows.columns else slug, required, departments), n_rows)
    return rows


def build_rules(inventory: DataFrame, overrides: DataFrame, name: str = "chair_name", url: str = "project_study_url", kind: str = "project_study") -> DataFrame:
    """A rule for each inventory row: the defaults, replaced where overrides (name, ...) state a column.

    overrides may hold any of the array columns of DEFAULTS, `drop_excluded` (markers to take out of
    the excluded ones), title_selector, offer_link_selector, classify_link_targets and source_implies_active_type.
    """
    scalars = {"title_selector": "string", "offer_link_selector": "string", "classify_link_targets": "boolean", "source_implies_active_type": "boolean"}
    stated = set(overrides.columns)
    o = overrides.select(F.col(name).alias("__name"), *(F.col(c).alias(f"__{c}") for c in stated - {name}))
    joined = inventory.join(o, inventory[name] == o["__name"], "left")
    value = lambda c, default: F.coalesce(F.col(f"__{c}"), default) if c in stated else default
    rules = {c: value(c, default_rule(c)) for c in DEFAULTS}
    if "drop_excluded" in stated:
        rules["excluded_markers"] = F.array_except(rules["excluded_markers"], F.coalesce("__drop_excluded", F.array().cast("array<string>")))
    rules |= {c: value(c, F.lit(None if t == "string" else False).cast(t)) for c, t in scalars.items()}
    return joined.select(slugify(F.col(name)).alias("slug"), F.col(name).alias("name"), F.col(url).alias("source_url"), parser_family(F.col(url)).alias("family"), F.lit(kind).alias("opportunity_type"), *(c.alias(n) for n, c in rules.items()))


def read_hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a five-column CSV whose names may hold commas without quotes.

    A line with more fields than columns is put right from both ends: the first field is the school's
    slug, the last the url, and the inner field of a-z, 0-9 and hyphens the department's slug. A line
    that has no or several such fields is set aside. Empty values are null.
    """
    lines = spark.read.text(path).toDF("line").where(F.trim("line") != "")
    stated = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(r',("(?:[^"]|"")*"(?=,|$)|[^,]*)'), F.lit(1))
    bare = F.transform(stated, lambda x: F.when(F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"')) & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    parsed = lines.select("line", bare.alias("f"))
    parsed = parsed.where(F.array_join("f", ",") != ",".join(HIERARCHY))
    good = parsed.where(F.size("f") == len(HIERARCHY)).select(*(F.element_at("f", i + 1).alias(c) for i, c in enumerate(HIERARCHY)))
    wide = parsed.where(F.size("f") != len(HIERARCHY))
    inner = F.filter(F.sequence(F.lit(2), F.size("f") - 2), lambda i: F.element_at("f", i + 1).rlike("^[a-z0-9-]+$"))
    wide = wide.select("line", "f", F.when(F.size("f") > len(HIERARCHY), inner).alias("at"))
    sound = F.coalesce(F.size("at") == 1, F.lit(False))
    at, n = F.element_at("at", 1), F.size("f")
    mended = wide.where(sound).select(
        F.element_at("f", 1).alias("school_slug"), F.array_join(F.slice("f", 2, at - 1), ",").alias("school"), F.element_at("f", at + 1).alias("department_slug"),
        F.array_join(F.slice("f", at + 2, n - at - 2), ",").alias("department"), F.element_at("f", -1).alias("source_url"),
    )
    rows = good.unionByName(mended)
    return rows.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in HIERARCHY)), wide.where(~sound).select("line")


def read_units(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; empty values are null."""
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return rows.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
