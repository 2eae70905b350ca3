"""Text expressions shared by the operators; all native, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelled the same for Java's and RE2's regular expressions.
WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    """T-1: tokens of a text by its words, floor(words * 4 / 3) and at least 1. Null for null."""
    return F.greatest(F.lit(1), (F.size(words(c)) * 4 / 3).cast("int"))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as ``_``; where nothing is left, the start of the md5."""
    plain = F.trim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(plain, F.lit("")), F.substring(F.md5(c), 1, 8))


def entity_id(type_: Column, name: Column) -> Column:
    """Id of an entity from its type and name."""
    return F.concat_ws("_", F.lit("entity"), slug(type_), slug(name))


def relationship_id(source: Column, kind: Column, target: Column) -> Column:
    """Id of a relationship from its three parts."""
    return F.concat_ws("__", F.lit("rel"), source, kind, target)


def title_case(c: Column) -> Column:
    """Every run of letters starts in upper case, digits and apostrophes start a new one."""
    letters = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(letters, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def sentences(c: Column) -> Column:
    """Sentences of a text, ended by ``.``, ``!`` or ``?`` before white space; an array without blank ones."""
    return F.filter(F.split(squeeze(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def snippet(c: Column, length: int = 200) -> Column:
    """A3: start of a text, stripped, line feeds as blanks."""
    return F.substring(F.replace(strip(c), F.lit("\n"), F.lit(" ")), 1, length)


def label_of(c: Column) -> Column:
    """A type as a label, other characters than letters, digits and ``_`` removed; null where nothing is left."""
    return F.nullif(F.regexp_replace(c, "[^A-Za-z0-9_]", ""), F.lit(""))


def occurrences(text: Column, part: Column) -> Column:
    """Positions (from 0) of all occurrences of ``part`` in ``text`` that do not overlap, left to right."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    ends = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p) + F.char_length(part)).cast("int").alias("at"),
            F.array_append(acc["found"], (acc["at"] + F.char_length(p)).cast("int")).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.slice(ends, 1, F.size(ends) - 1)
