"""Name, season and position codes as Column expressions (P-9, P-14 to P-17)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one letter and combining marks, and
    those letters; made from Unicode data."""
    marked, plain = [], []
    for code in range(0xC0, 0x2000):
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code) and parts[0].isalpha():
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def strip_accents(c: Column) -> Column:
    marked, plain = fold_table()
    return F.regexp_replace(F.translate(c, marked, plain), r"[̀-ͯ]", "")


def title_case(c: Column) -> Column:
    """Each run of letters gets a capital and small letters (``O'Brien``, ``Jean-Luc``)."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda x: F.initcap(x)), "")


def drop_brackets(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*(\([^)]*\)|\[[^\]]*\])", ""))


def first_last(c: Column) -> Column:
    """``Last, First`` as ``First Last``."""
    parts = F.split(c, ",", 2)
    return F.when(F.contains(c, F.lit(",")), F.trim(F.concat(F.trim(parts[1]), F.lit(" "), F.trim(parts[0])))).otherwise(c)


def standard_name(c: Column, known: Column | None = None) -> Column:
    """P-15: trim, known variation (if joined; it goes on like a given name), brackets,
    order, accents, title case."""
    name = F.coalesce(known, F.trim(c)) if known is not None else F.trim(c)
    return title_case(strip_accents(first_last(drop_brackets(name))))


def simple_name(c: Column) -> Column:
    """P-14: trim and title case."""
    return title_case(F.trim(c))


def season_code(c: Column) -> Column:
    """P-9: ``2023/24``, ``2023-24`` and ``2023_24`` as ``2324``; others null."""
    m = F.regexp_extract(c, r"^\d{2}(\d{2})[/_-](\d{2})$", 0)
    return F.when(m != "", F.concat(F.substring(m, 3, 2), F.right(m, F.lit(2))))


def valid_season(c: Column, first: int = 2016, last: int = 2026) -> Column:
    """Whether a season is ``YYYY-YY`` of two years in a row within the bounds; null is not."""
    start = F.substring(c, 1, 4).try_cast("int")
    good = c.rlike(r"\A\d{4}-\d{2}\z") & ((start + 1) % 100 == F.right(c, F.lit(2)).try_cast("int")) & start.between(first, last)
    return F.coalesce(good, F.lit(False))


def position(c: Column) -> Column:
    """P-16: a position code as one of four, else its first letter; "" for null and empty."""
    table = F.create_map(*[F.lit(x) for pair in config.POSITIONS.items() for x in pair])
    upper = F.upper(c)
    return F.when(c.isNull() | (c == ""), "").otherwise(F.coalesce(table[upper], F.substring(upper, 1, 1)))


def element_type(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in config.ELEMENT_TYPES.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def team_name(c: Column, names: dict | None = None) -> Column:
    """P-17: a team's name in the other source, itself if unknown."""
    table = F.create_map(*[F.lit(x) for pair in (names or config.TEAM_NAMES).items() for x in pair])
    return F.coalesce(table[c], c)


def day(c: Column) -> Column:
    """P-26: the date of a time stamp string."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def stable_id(kind: str, *parts: Column) -> Column:
    """An id that depends on its natural key only."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
