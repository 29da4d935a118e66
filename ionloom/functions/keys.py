"""Molecule keys and names that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_key(col: Column) -> Column:
    """The 14 capital letters of a molecule key, however it is written; NULL where there is none.

    White space anywhere, lower case, an ``InChIKey=`` prefix and the later blocks of a full key don't count.
    """
    bare = F.regexp_replace(F.upper(F.regexp_replace(col, r"[\s ​﻿]", "")), "^INCHIKEY[=:]", "")
    return F.when(bare.rlike("^[A-Z]{14}(-.*)?$"), F.substring(bare, 1, 14))


def clean_name(col: Column) -> Column:
    """A library or source name in lower case, trimmed, with ``-`` for ``_`` and blanks."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(col, r"\s+", " "))), "[_ ]", "-")
