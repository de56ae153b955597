"""Parsers of generated text, as column expressions, and language detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def detect_language(text: Column) -> Column:
    """ru or en by the larger share of letters; null for a text without either."""
    ru, en = F.length(F.regexp_replace(text, "[^А-Яа-яЁё]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(ru + en == 0, None).when(ru > en, "ru").otherwise("en")


#: Signs cut from the ends of the parts of triplets, theses and replacements (fixed values).
PART_ENDS, LAST_ENDS, LIST_ENDS = " \n'\".,/\\", " \n'\".;,/\\", " \n'\".,;/"


def triplet_lines(raw: Column, strict: bool = False) -> Column:
    """array<struct<s, r, o>> of the lines that have three parts between bars, lower case, stripped.

    A part without letters is an error: with strict it raises, else the whole answer gives null.
    """
    made = F.transform(F.filter(F.transform(F.split(F.lower(raw), "\n"), lambda x: F.split(x, "\\|", -1)), lambda p: F.size(p) == 3), lambda p: F.struct(F.btrim(p[0], F.lit(PART_ENDS)).alias("s"), F.btrim(p[1], F.lit(PART_ENDS)).alias("r"), F.btrim(p[2], F.lit(LAST_ENDS)).alias("o")))
    bad = F.exists(made, lambda t: (t.s == "") | (t.r == "") | (t.o == "")) | (F.length(raw) == 0)
    wrong = F.raise_error(F.concat(F.lit("no triplets in: "), raw)).cast("array<struct<s:string,r:string,o:string>>") if strict else F.lit(None)
    return F.when(bad, wrong).otherwise(made)


def triplet_list(raw: Column, strict: bool = False) -> Column:
    """The first version of triplet_lines: triplets between semicolons, parts between commas, after the last colon."""
    last = lambda x, sign: F.element_at(F.split(x, sign, -1), -1)
    cut = lambda x: F.btrim(x, F.lit(PART_ENDS))
    parts = F.filter(F.transform(F.split(F.lower(last(raw, ":")), ";", -1), lambda x: F.split(x, ",", -1)), lambda p: F.size(p) == 3)
    made = F.transform(parts, lambda p: F.struct(cut(last(p[0], "\\.")).alias("s"), cut(p[1]).alias("r"), cut(p[2]).alias("o")))
    bad = F.exists(made, lambda t: (t.s == "") | (t.r == "") | (t.o == "")) | (F.length(raw) == 0)
    wrong = F.raise_error(F.concat(F.lit("no triplets in: "), raw)).cast("array<struct<s:string,r:string,o:string>>") if strict else F.lit(None)
    return F.when(bad, wrong).otherwise(made)


def theses(raw: Column) -> Column:
    """array<struct<thesis, entities>> of the lines 'text | [list]', lower case; a line without a bar, with two, or with a list that can't be read is skipped."""
    lines = F.filter(F.transform(F.split(F.lower(raw), "\n"), lambda x: F.split(x, "\\|", -1)), lambda p: F.size(p) == 2)
    items = lambda x: F.from_json(F.regexp_replace(F.btrim(x, F.lit(LIST_ENDS)), r"(?<=[\[,\s])'|'(?=\s*[,\]])", '"'), "array<string>")
    made = F.transform(lines, lambda p: F.struct(F.trim(p[0]).alias("thesis"), items(p[1]).alias("entities")))
    return F.filter(made, lambda t: t.entities.isNotNull() & ~F.exists(t.entities, lambda e: e.isNull()))


def name_list(raw: Column, version: int = 1) -> Column:
    """Names between bars. Empty ones are dropped by the first version; for the second they make the whole answer null."""
    names = F.transform(F.split(F.btrim(raw, F.lit(" .")), "\\|", -1), lambda x: F.trim(x))
    if version == 1:
        return F.filter(names, lambda x: x != "")
    return F.when(~F.exists(names, lambda x: x == ""), names)


def replacements(raw: Column) -> Column:
    """array<struct<old, new>> of md5s from '[[s, r, o -> s, r, o], ...]', lower case; pairs of another form are skipped."""
    low = F.lower(raw)
    inner = F.when(F.contains(low, F.lit("[[")), F.element_at(F.split(low, "\\[\\[", -1), -1)).otherwise(F.element_at(F.split(low, "\\[\n\\[", -1), -1))
    sides = F.transform(F.split(F.btrim(F.replace(inner, F.lit("["), F.lit("")), F.lit("]")), "\\],", -1), lambda p: F.split(p, "->", -1))
    good = F.filter(sides, lambda p: (F.size(p) == 2) & (F.size(F.split(p[0], ",", -1)) == 3) & (F.size(F.split(F.get(p, 1), ",", -1)) == 3))
    cut = lambda x: F.md5(F.btrim(x, F.lit(" \n'\".,/")))
    return F.transform(good, lambda p: F.struct(cut(p[0]).alias("old"), cut(F.regexp_replace(p[1], r"\]+\s*$", "")).alias("new")))


def thesis_replacements(raw: Column) -> Column:
    """array<struct<old, new>> of md5s from '["new <- old", ...]', lower case."""
    inner = F.split(F.element_at(F.split(F.lower(raw), "\\[", -1), -1), "\\]", -1)[0]
    sides = F.filter(F.transform(F.split(inner, '", "', -1), lambda p: F.split(p, "<-", -1)), lambda p: F.size(p) == 2)
    cut = lambda x: F.md5(F.btrim(x, F.lit(" \n'\".,/")))
    return F.transform(sides, lambda p: F.struct(cut(p[1]).alias("old"), cut(p[0]).alias("new")))


def dashed(raw: Column) -> Column:
    """Lines of a list with or without dashes, in order, without empty ones."""
    return F.filter(F.transform(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit("- "))), lambda x: x != "")


def summary(raw: Column) -> Column:
    """The line after [Output Summary] at the end of the answer, else the whole answer; null if it is empty."""
    whole = F.btrim(raw, F.lit(" ."))
    found = F.regexp_extract(whole, r"\[Output Summary\]\n(.+)$", 1)
    return F.when(F.length(whole) > 0, F.when(found != "", found).otherwise(whole))


def after_marker(raw: Column, marker: str) -> Column:
    """What follows [marker], in any case, trimmed; null without it."""
    found = F.regexp_extract(raw, rf"(?is)\[{marker}\](.*)", 1)
    return F.when(F.locate(f"[{marker.lower()}]", F.lower(raw)) > 0, F.trim(found))


def truth(raw: Column) -> Column:
    """True as soon as the text says so, else False if it says that, else null."""
    return F.when(F.lower(raw).contains("true"), True).when(F.lower(raw).contains("false"), False)


def numbered(raw: Column) -> Column:
    """Items of a numbered list, in order."""
    lines = F.transform(F.split(raw, "\n"), lambda x: F.regexp_extract(x, r"^\d{1,2}\. (.*)", 1))
    return F.filter(lines, lambda x: x != "")


def context(texts: Column) -> Column:
    return F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), F.trim(t))), "\n")).otherwise("|Empty|")
