"""Normalizers of parsed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, any_of, blank, strip

# Certificate spellings and their display names.
CERTIFICATES = {
    "cissp": "CISSP",
    "security+": "CompTIA Security+",
    "sec+": "CompTIA Security+",
    "ceh": "CEH",
    "cism": "CISM",
    "cisa": "CISA",
    "oscp": "OSCP",
    "gcih": "GCIH",
    "aws certified security": "AWS Certified Security",
}


def normalize_remote(policy: Column | str) -> Column:
    p = F.lower(blank(policy))
    return (
        F.when(F.contains(p, F.lit("hybrid")), "hybrid")
        .when(F.contains(p, F.lit("remote")), "remote")
        .when(p.rlike(any_of(["onsite", "office", "in-person", "in person"])), "onsite")
        .otherwise("unknown")
    )


def normalize_tech(tech: Column | str) -> Column:
    """Lowercase, strip and drop blanks; order and repeats stay."""
    cleaned = F.transform(F.array_compact(_col(tech)), lambda t: strip(F.lower(t)))
    return F.filter(cleaned, lambda t: t != "")


def normalize_certs(certs: Column | str) -> Column:
    """Display names where known, else the stripped text; distinct and sorted."""
    names = F.create_map(*[F.lit(x) for pair in CERTIFICATES.items() for x in pair])
    cleaned = F.filter(F.transform(F.array_compact(_col(certs)), strip), lambda c: c != "")
    mapped = F.transform(cleaned, lambda c: F.coalesce(F.try_element_at(names, F.lower(c)), c))
    return F.array_sort(F.array_distinct(mapped))


def normalize_currency(currency: Column | str) -> Column:
    c = strip(F.upper(blank(currency)))
    return F.when(F.length(c) == 3, c).otherwise("USD")
