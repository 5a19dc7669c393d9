"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

A word is ``[^\\x20\\x09-\\x0D]+``.  Each rule bounds one measure of a text from below and above; the
table is compiled into one struct of measures and one boolean.  Arrays are bound once by a
one-element ``transform``, so no measure is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
#: The symbols counted.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of four languages.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "with", "in", "is", "for", "it", "was", "are", "this", "as", "on", "a", "by", "from", "an", "at",
              "der", "die", "das", "und", "ist", "nicht", "den", "mit", "von", "zu", "ein", "eine", "für", "auf", "im", "des", "dem", "sich", "auch",
              "le", "la", "les", "de", "et", "un", "une", "du", "en", "que", "qui", "pour", "dans", "par", "sur", "au", "est", "pas",
              "el", "los", "las", "y", "una", "por", "con", "para", "se", "del", "lo", "su", "al")


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; None leaves a side open.  Texts with a word_count under ``from_words`` pass."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The default thresholds.
RULES = (
    Rule("length", "n_words", low=10),
    Rule("word length", "chars_per_word", low=2.0, high=16.0),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("stop words", "stop_ratio", low=0.05, from_words=30),
    Rule("repeated lines", "dup_line_ratio", high=0.4),
    Rule("repeated words", "repeat_ratio", high=0.2),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in ``width``-word windows found twice or more; linear but for a sort of texts that repeat themselves."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(starts)), lambda k: F.when(k < F.size(starts), F.least(F.lit(width), F.get(starts, k) - F.get(starts, k - 1))).otherwise(F.lit(width)))
        return F.when(F.size(starts) > 0, F.aggregate(gaps, F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0))

    def starts(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(keyed, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda x: x.isNotNull())))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(starts(hashes), covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), count))).cast("long")


def measures(text: Column, width: int = 5) -> Column:
    """A struct of counts and ratios of a text; a null text counts as empty, ratios of nothing are 0."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))

    def counted(x: Column) -> Column:
        t, w, ls = x["t"], x["w"], x["l"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w, width).alias("n_repeat_words"),
            F.size(F.filter(w, lambda v: F.lower(v).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def ratios(m: Column) -> Column:
        per = lambda a, b: F.when(m[b] > 0, m[a] / m[b]).otherwise(F.lit(0.0))
        return F.struct(
            *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")],
            per("word_chars", "n_words").alias("chars_per_word"),
            per("n_symbols", "n_words").alias("symbols_per_word"),
            per("n_stop_words", "n_words").alias("stop_ratio"),
            per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
            per("n_repeat_words", "n_words").alias("repeat_ratio"),
        )

    return let(let(F.struct(text.alias("t"), words.alias("w"), lines.alias("l")), counted), ratios)


def compiled(rules: tuple[Rule, ...], m: Column) -> Column:
    """True for a struct of measures that meets every rule."""
    out = F.lit(True)
    for r in rules:
        met = F.lit(True)
        if r.low is not None:
            met = met & (m[r.measure] >= F.lit(r.low))
        if r.high is not None:
            met = met & (m[r.measure] <= F.lit(r.high))
        out = out & (met | (m["n_words"] < r.from_words) if r.from_words else met)
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``measures``, ``base_failed`` and ``kept``; no shuffle, one row per row.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows.  Null and
    empty texts fail it.  Columns of ``docs`` with these names are replaced.
    """
    out = docs.withColumn("measures", measures(F.col(text)))
    m = F.col("measures")
    out = out.withColumn("base_failed", (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20))
    return out.withColumn("kept", ~F.col("base_failed") & compiled(rules, m))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The digest: doc_id, the counts, base_failed and kept."""
    out = judged(docs, rules)
    return out.select("doc_id", *[F.col(f"measures.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")], "base_failed", "kept")
