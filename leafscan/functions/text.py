"""Recognised text as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space besides the Unicode property.
WHITE = "(?U)[\\s\\x1c-\\x1f]+"


def strip_white(text: Column) -> Column:
    """Without any white space, Unicode's included."""
    return F.regexp_replace(text, WHITE, "")


def dot_runs(text: Column) -> Column:
    """Runs of two or more of ``・`` and ``.`` as as many full stops; a lone one stays."""
    return F.regexp_replace(text, "(?<=[・.])・|・(?=[・.])", ".")


@cache
def _wide() -> tuple[str, str, dict[str, str]]:
    """Half-width characters, their full-width forms, and pairs with a voicing mark, by Unicode's compatibility forms."""
    half = "".join(map(chr, range(0x21, 0x7F)))
    full = "".join(chr(ord(c) + 0xFEE0) for c in half)
    kana = [chr(c) for c in range(0xFF61, 0xFFA0)]
    for c in kana[:-2]:
        half += c
        full += unicodedata.normalize("NFKC", c)
    half += "ﾞﾟ"
    full += "゛゜"
    pairs = {}
    for c in kana:
        for mark in "ﾞﾟ":
            joined = unicodedata.normalize("NFKC", c + mark)
            if len(joined) == 1:
                pairs[c + mark] = joined
    return half, full, pairs


def half_to_full(text: Column) -> Column:
    """ASCII from ``!`` to ``~`` and half-width kana as full-width characters."""
    half, full, pairs = _wide()
    marked = text
    for pair, joined in pairs.items():
        marked = F.replace(marked, F.lit(pair), F.lit(joined))
    voiced = F.when(text.rlike("[ﾞﾟ]"), marked).otherwise(text)
    return F.translate(voiced, half, full)


def normalised(text: Column) -> Column:
    """White space out, ellipses to dots, dot runs, full width."""
    return half_to_full(dot_runs(F.replace(strip_white(text), F.lit("…"), F.lit("..."))))


def detokenised(tokens: Column) -> Column:
    """Tokens that are not special (opening with ``[``) or null, joined."""
    return F.array_join(F.filter(tokens, lambda t: t.isNotNull() & ~t.startswith("[")), "")


def with_line(text: Column, line: str, before: str) -> Column:
    """``text`` with a line put before the first ``before`` line, else before blank lines at the end; unchanged if it has it.

    Lines are compared without white space around them; the result's lines end in ``\\r\\n``.
    """
    lines = F.split(text, "\\r?\\n")
    has = F.exists(lines, lambda s: F.trim(s) == line)
    at = F.array_position(F.transform(lines, lambda s: F.trim(s) == before), True)
    last = F.array_max(F.transform(lines, lambda s, i: F.when(s != "", i + 1).otherwise(0)))
    place = F.when(at > 0, at - 1).otherwise(last).cast("int")
    size = F.size(lines)
    put = F.concat(F.slice(lines, F.lit(1), place), F.array(F.lit(line)), F.slice(lines, place + 1, size))
    return F.when(has, text).otherwise(F.array_join(put, "\r\n"))


def block_text(lines: Column) -> Column:
    """A block's lines with a space between them, without blanks at the ends."""
    return F.trim(F.array_join(lines, " "))


def joined_in_order(order: Column, text: Column, between: str = "") -> Column:
    """Aggregate: texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), between)


def label_line(kind: Column, *numbers: Column) -> Column:
    """A label file's line: class and whole numbers with blanks between them."""
    return F.concat_ws(" ", kind.cast("string"), *[n.cast("long").cast("string") for n in numbers])
