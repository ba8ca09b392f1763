"""Addresses, names and numbers as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The province's names, the first being the one kept; endings of institutions; the entities that are undone.
PROVINCE = "전북특별자치도"
PROVINCE_ALIASES = ("전라북도", "전북특별자치도", "전북")
INSTITUTIONS = ("신협", "금고", "은행", "우체국", "지점", "본점")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def address(x: Column) -> Column:
    """Without a leading postal code and parenthesised parts, under the province's one name, town and road parted, blanks collapsed."""
    a = F.regexp_replace(F.trim(x), r"^\(\d{5}\)\s*", "")
    a = F.regexp_replace(a, r"\s*\([^)]*\)\s*", " ")
    a = F.regexp_replace(a, "^(?:" + "|".join(PROVINCE_ALIASES) + ")", PROVINCE)
    return collapse(F.regexp_replace(a, "([가-힣]+[읍면])([가-힣]+(?:로|길|대로))", "$1 $2"))


def without_institution(x: Column, name: Column) -> Column:
    """Without the last word if it has no digit and is an institution: its name has the word or the word's first two characters, or the word ends like one."""
    word = last_word(x)
    known = F.contains(name, F.substring(word, 1, 2)) | F.contains(name, word) | reduce(Column.__or__, (F.endswith(word, F.lit(e)) for e in INSTITUTIONS))
    return F.when((word != "") & ~word.rlike(r"\d") & known, F.trim(F.regexp_replace(x, r"\S+$", ""))).otherwise(x)


def compact_address(x: Column) -> Column:
    """Digits, Latin letters and syllables only, without the province."""
    return F.regexp_replace(F.regexp_replace(x, "전라북도|전북특별자치도", ""), "[^0-9A-Za-z가-힣]", "")


def in_province(x: Column) -> Column:
    return F.when(x.rlike("^(?:전북특별자치도|전라북도)"), x).otherwise(F.concat(F.lit(PROVINCE + " "), x))


def base_name(x: Column) -> Column:
    """What stands before a bracket, or all if that is nothing."""
    return or_default(F.regexp_replace(x, r"\(.*$", ""), x)


def road_lead(x: Column) -> Column:
    """Up to the number after a road's name; without one: empty."""
    return F.regexp_extract(x, r"^(.*?(?:로|길)\s*\d+)", 1)


def last_word(x: Column) -> Column:
    return F.regexp_extract(x, r"(\S+)$", 1)


def holds(x: Column, part: Column) -> Column:
    """Whether x has the part, blanks left aside in both."""
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    return F.contains(bare(x), bare(part))


def unescaped(x: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, x)


def or_default(x: Column, default: Column) -> Column:
    """x trimmed, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), default)


def number(x: Column) -> Column:
    """A number with separators of thousands; blank: null."""
    return F.replace(F.nullif(F.trim(x), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def joint_city(x: Column) -> Column:
    """A city's districts under the city's own name."""
    return F.when(F.startswith(x, F.lit("전주시")), "전주시").otherwise(x)
