"""Names, ids and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def safe_name(c: Column) -> Column:
    """Apply it to both sides of a join of names."""
    return F.regexp_replace(F.coalesce(blank_to_null(c), F.lit("unknown")), r"[^A-Za-z0-9._-]+", "_")


def accession(c: Column) -> Column:
    """The base accession number at the begin of a text, or null."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(c)), r"^(B\d{2,4}\.\d{2,5})", 1), F.lit(""))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def parent(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/[^/]*$", 1)


def case_id(source: Column, case: Column, slide: Column) -> Column:
    """source::CASE, or source::SLIDE::stem where no case is known."""
    s = F.lower(F.trim(source))
    return F.coalesce(F.concat(s, F.lit("::"), F.upper(blank_to_null(case))), F.concat(s, F.lit("::SLIDE::"), stem(slide)))


#: How an id names its source, by dataset.
SOURCE_GROUPS = {
    "osteo": lambda b: F.coalesce(F.nullif(F.regexp_extract(b, r"^(Case-\d+)", 1), F.lit("")), b),
    "sicap": lambda b: F.substring_index(b, "_", 1),
    "wsss4luad": lambda b: F.substring_index(b, "-", 1),
    "databiox": lambda b: F.regexp_replace(b, r"_40x_\d+\.\w+$", ""),
}


def source_group(dataset: str, path: Column) -> Column:
    """The biological source in an item's id; null where the dataset has none."""
    return SOURCE_GROUPS[dataset](basename(path)) if dataset in SOURCE_GROUPS else F.lit(None).cast("string")


def fill_template(template: Column, name: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{}"), name), F.lit("CLASSNAME"), name)
