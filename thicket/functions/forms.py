"""Compared forms of values, references, paths and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def value_form(c: Column) -> Column:
    """Runs of blanks, tabs, line feeds, hyphens and underscores as one blank, trimmed, in lower case."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n_-]+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def reference_form(c: Column) -> Column:
    """The last path segment of a reference: trimmed, lower case, no fragment, no closing ``.md``."""
    c = F.substring_index(F.lower(strip(c)), "#", 1)
    return strip(F.regexp_replace(F.substring_index(c, "/", -1), r"\.md\z", ""))


def path_form(c: Column) -> Column:
    """Slashes one way and single, no leading ``./``; letter case stays."""
    c = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"/+", "/")
    return F.regexp_replace(c, r"^(\./)+", "")


def hash_form(c: Column) -> Column:
    """Lower case, without the prefix that ends in a colon."""
    return F.regexp_replace(F.lower(c), r"^[^:]*:", "")


VALUE_SQL = "trim(regexp_replace(lower({}), '[ \\t\\n_-]+', ' ', 'g'))"
STRIP_SQL = "regexp_replace({}, '^\\s+|\\s+\\z', '', 'g')"
REFERENCE_SQL = STRIP_SQL.format(
    "regexp_replace(regexp_replace(regexp_replace(lower(" + STRIP_SQL.replace("{}", "{0}") + "), '(?s)#.*', ''), '(?s)^.*/', ''), '\\.md\\z', '')"
)
PATH_SQL = "regexp_replace(regexp_replace(replace({}, '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '')"
HASH_SQL = "regexp_replace(lower({}), '^[^:]*:', '')"
