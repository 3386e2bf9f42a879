"""Parsers of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def locus_files(html: Column) -> Column:
    """Names of linked .fasta.gz files but those of references, sorted."""
    names = F.regexp_extract_all(html, F.lit(r'href="([^"]+)\.fasta\.gz"'), F.lit(1))
    return F.array_sort(F.filter(names, lambda n: ~n.endswith("_ref") & ~n.endswith(".ref")))


def locus_count(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "").try_cast("int")
