"""Name folding and normalisation as column expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from terrace import fixed_values as V


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose full compatibility decomposition has one ASCII character, and those that give several.

    A character's ASCII part does not depend on its neighbours, so the tables cover every text.
    """
    src, dst, multi = [], [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        ascii_part = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(ascii_part) == 1:
            src.append(c)
            dst.append(ascii_part)
        elif len(ascii_part) > 1:
            multi[c] = ascii_part
    return "".join(src), "".join(dst), multi


def fold_ascii(text: Column) -> Column:
    """Strip accents; characters without an ASCII part are dropped."""
    src, dst, multi = _fold_tables()
    single = F.translate(F.coalesce(text, F.lit("")), src, dst)
    several = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")  # one literal once the plan is optimised
    letters = F.regexp_extract_all(single, F.lit("(?s)."), F.lit(0))
    spread = F.array_join(F.transform(letters, lambda c: F.when(c > "\x7f", F.coalesce(F.try_element_at(several, c), c)).otherwise(c)), "")
    folded = F.when(single.rlike(r"[^\x00-\x7F]"), spread).otherwise(single)
    return F.regexp_replace(folded, r"[^\x00-\x7F]", "")


def normalize_name(text: Column, drop_tokens: str = V.CLUB_DROP_TOKENS) -> Column:
    """Accent-free lower-case letters and digits, without club-form tokens."""
    s = F.lower(fold_ascii(text))
    s = F.replace(F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("-"), F.lit(" ")), F.lit("."), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(s, drop_tokens, " "), r"[^a-z0-9]", "")


def to_int(text: Column) -> Column:
    """Whole number or null.  The pattern test avoids the cost of failed casts on dirty feeds."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d{1,9}$"), t.cast("int"))


def to_double(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"), t.cast("double"))


def grams(text: Column, widths: Sequence[int]) -> Column:
    """Distinct runs of each of ``widths`` characters; as many as the text is long for each width."""
    n = F.length(text)
    none = F.array().cast("array<string>")

    def runs(width: int) -> Column:
        return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.substring(text, i, width))).otherwise(none)

    return F.array_distinct(F.concat(*map(runs, widths)))


def trigrams(text: Column) -> Column:
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, 3))
    return F.when(n > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two short names, on Arrow batches."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
