"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanline.llm.text import BLANK, split_words

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for as was with be by on not he his but at are this have from or had an they which you were "
    "le la les un une des du de et en est que qui dans pour par sur au avec ce il elle ne pas plus se "
    "der die das den dem ein eine und ist zu von mit auf für im nicht es sich auch als an werden aus er hat dass sie nach bei "
    "el los las y o del al con por para como más pero sus lo su si ya entre cuando muy sin sobre"
).split()

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text fails if ``measure`` (a name of ``MEASURES``) lies below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Ratios by name, over the counts of ``_counts``.
MEASURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "letter_share": "n_letters / word_chars",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "stop_word_share": "n_stop_words / n_words",
    "repeated_line_share": "n_dup_lines / n_lines",
    "list_line_share": "n_list_lines / n_lines",
    "cut_line_share": "n_cut_lines / n_lines",
}

RULES = [
    Rule("short_words", "mean_word_chars", least=2),
    Rule("long_words", "mean_word_chars", most=20),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("marks", "marks_per_word", most=0.5),
    Rule("letters", "letter_share", least=0.6),
    Rule("capitals", "upper_share", most=0.6),
    Rule("stop_words", "stop_word_share", least=0.01),
    Rule("repeated_lines", "repeated_line_share", most=0.3),
    Rule("lists", "list_line_share", most=0.9),
    Rule("cut_lines", "cut_line_share", most=0.3),
]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kept_chars(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def _repeats(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more.

    Windows are compared by hash first; only where hashes repeat are they sorted and compared as texts.
    """
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def exact(again: Column) -> Column:
        windows = F.transform(again, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, WINDOW)).alias("w"), i.alias("i")))

        def found(ordered: Column) -> Column:
            def equal(x: Column, j: Column) -> Column:
                near = [F.coalesce(F.get(ordered, k)["w"] == x["w"], F.lit(False)) for k in (j - 1, j + 1)]
                return near[0] | near[1]

            return F.array_sort(F.transform(F.filter(ordered, equal), lambda x: x["i"]))

        return F.aggregate(
            _let(F.array_sort(windows), found),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("up")),
            lambda s, i: F.struct((s["n"] + (i + WINDOW - F.greatest(i, s["up"]))).alias("n"), (i + WINDOW).alias("up")),
            lambda s: s["n"],
        )

    unique = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(starts))
    return _let(hashes, unique)


def _counts(text: Column) -> Column:
    """All counts of a text as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))
    letters = F.regexp_replace(text, r"\P{L}+", "")

    def of_words(words: Column) -> list[Column]:
        return [
            F.size(words).cast("long").alias("n_words"),
            _repeats(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ]

    def of_lines(lines: Column) -> list[Column]:
        return [
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(f"^[{BLANK}]*[-*•|]"))).cast("long").alias("n_list_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(f"(\\.\\.\\.|…)[{BLANK}]*$"))).cast("long").alias("n_cut_lines"),
        ]

    def of_letters(letters: Column) -> list[Column]:
        return [F.length(letters).cast("long").alias("n_letters"), _kept_chars(letters, r"\P{Lu}+").alias("n_upper")]

    parts = [
        _let(split_words(text), lambda w: F.struct(*of_words(w))),
        _let(lines, lambda x: F.struct(*of_lines(x))),
        _let(letters, lambda x: F.struct(*of_letters(x))),
    ]
    own = F.struct(
        _kept_chars(text, f"[{BLANK}]+").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[!?]", ""))).cast("long").alias("n_marks"),
    )
    return F.struct(own.alias("chars"), parts[0].alias("words"), parts[1].alias("lines"), parts[2].alias("letters"))


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept, failed): a row for each row of ``docs``, from one projection.

    ``base_failed``: fewer than 20 words, or over 30% of words in repeated windows of 8. ``failed`` names the rules of
    the table that a text breaks, in its order; ``kept`` is true if none is broken and the base did not fail. A null
    text counts as an empty one, which fails the base. Repeated rows are judged alike, other columns are ignored.
    """
    rules = RULES if rules is None else rules
    counted = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _counts(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("c"))
    counted = counted.select("doc_id", "c.chars.*", "c.words.*", "c.lines.*", "c.letters.*")
    bounds = []
    for rule in rules:
        measure = F.expr(f"try_divide(1.0D * ({MEASURES[rule.measure].split(' / ')[0]}), {MEASURES[rule.measure].split(' / ')[1]})")
        outside = F.lit(False)
        if rule.least is not None:
            outside = outside | (measure < rule.least)
        if rule.most is not None:
            outside = outside | (measure > rule.most)
        bounds.append(F.when(F.coalesce(outside, F.lit(False)), F.lit(rule.name)))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*bounds)) if bounds else F.array().cast("array<string>")
    return counted.select("*", base_failed.alias("base_failed"), failed.alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )
