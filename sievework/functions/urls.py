"""URL and media type functions."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Media types by the ending of a path.
BY_ENDING = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".html": "text/html", ".htm": "text/html", "/": "text/html"}
UNKNOWN_TYPES = ("", "application/octet-stream")
# Hosts whose pages another parser family reads; all others are typo3.
LEGACY_HOSTS = ("www.bwl.wi.tum.de",)
SQUARESPACE_HOSTS = ("www.tumcso.com",)


def path_of(url: Column) -> Column:
    """The path of an absolute URL, without parameters, query and fragment; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def media_type(header: Column, url: Column) -> Column:
    """The type a response states, without parameters; one that says nothing is told from the URL's ending."""
    stated = F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))))
    path = F.lower(F.split_part(url, F.lit("?"), F.lit(1)))
    told = F.when(~stated.isin(*UNKNOWN_TYPES), stated)
    for ending, kind in BY_ENDING.items():
        told = told.when(F.endswith(path, F.lit(ending)), kind)
    return told.otherwise(stated)


def is_pdf_url(url: Column) -> Column:
    return F.endswith(F.lower(F.regexp_replace(url, "[?#;].*$", "")), F.lit(".pdf"))


def storage_key(digest: Column) -> Column:
    """Where a body lies in a content-addressed store."""
    return F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.lit(".pdf"))


def parser_family(url: Column, legacy: Sequence[str] = LEGACY_HOSTS, squarespace: Sequence[str] = SQUARESPACE_HOSTS) -> Column:
    host = host_of(url)
    return F.when(host.isin(*legacy), "legacy_html").when(host.isin(*squarespace), "squarespace").otherwise("typo3")


@F.pandas_udf(StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """Absolute forms of links; one that cannot be parsed stays as it is, null stays null."""

    def one(b, x):
        if x is None:
            return None
        try:
            return urljoin(b or "", x)
        except ValueError:
            return x

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)
