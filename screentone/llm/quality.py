"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the of and to in is that for it with as was on by are this be from at or an "
    "der die das und von zu mit den ist im für des ein eine nicht auf sich "
    "le la les de des et du un une est que en dans pour au pas "
    "el los las del y se que una por con no su para al lo"
).split()

#: (metric, comparison that rejects, bound): a row is rejected if any rule holds.
RULES = [
    ("n_words", "<", 10.0),
    ("n_words", ">", 1_000_000.0),
    ("mean_word_chars", "<", 1.5),
    ("mean_word_chars", ">", 25.0),
    ("symbol_ratio", ">", 0.08),
    ("repeat_ratio", ">", 0.20),
    ("dup_line_ratio", ">", 0.50),
    ("upper_ratio", ">", 0.60),
    ("stop_ratio", "<", 0.005),
    ("bullet_line_ratio", ">", 0.90),
]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus the measures of each whole text, all as built-in expressions.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios the rules use.
    Null text counts as empty: all counts zero. Columns of these names are replaced; others stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # windows are compared by a 64-bit hash of five 64-bit word hashes
    hashes = "transform(__words, w -> xxhash64(w))"
    windows = "transform(sequence(0, size(__h) - 5), i -> xxhash64(__h[i], __h[i + 1], __h[i + 2], __h[i + 3], __h[i + 4]))"
    d = docs.withColumn("__text", text).withColumn("__words", words)
    d = d.withColumn("__h", F.expr(hashes))
    d = d.withColumn("__win", F.expr(f"CASE WHEN size(__h) >= 5 THEN {windows} ELSE cast(array() AS array<bigint>) END"))
    # most texts repeat no window; only the others are sorted
    d = d.withColumn(
        "__sorted",
        F.expr(
            "CASE WHEN size(array_distinct(__win)) < size(__win) THEN array_sort(transform(__win, (h, i) -> struct(h AS h, i AS i)))"
            " ELSE cast(array() AS array<struct<h: bigint, i: int>>) END"
        ),
    )
    d = d.withColumn(
        "__at",
        F.expr("array_sort(transform(filter(transform(__sorted, (x, j) -> struct(x.i AS i, x.h <=> get(__sorted, j - 1).h OR x.h <=> get(__sorted, j + 1).h AS r)), x -> x.r), x -> x.i))"),
    )
    lines = F.filter(F.split("__text", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.withColumn("__lines", lines)
    squeezed = F.length(F.translate("__text", " \t\n\x0b\f\r", ""))
    d = d.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": squeezed.cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.expr("aggregate(transform(__at, (p, j) -> least(5, coalesce(get(__at, j + 1) - p, 5))), 0L, (a, x) -> a + x)"),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_upper": (F.length("__text") - F.length(F.translate("__text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
            "n_lower": (F.length("__text") - F.length(F.translate("__text", "abcdefghijklmnopqrstuvwxyz", ""))).cast("long"),
            "n_bullet_lines": F.size(F.filter("__lines", lambda s: s.rlike("^\\s*[-*•]"))).cast("long"),
        }
    ).drop("__text", "__words", "__h", "__win", "__sorted", "__at", "__lines")
    c = F.col
    return d.withColumns(
        {
            "mean_word_chars": _ratio(c("word_chars"), c("n_words")),
            "symbol_ratio": _ratio(c("n_symbols"), c("word_chars")),
            "repeat_ratio": _ratio(c("n_repeat_words"), c("n_words")),
            "dup_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
            "stop_ratio": _ratio(c("n_stop_words"), c("n_words")),
            "upper_ratio": _ratio(c("n_upper"), c("n_upper") + c("n_lower")),
            "bullet_line_ratio": _ratio(c("n_bullet_lines"), c("n_lines")),
        }
    )


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one boolean column: true where a rule rejects."""
    out = F.lit(False)
    for metric, how, bound in rules:
        c = F.col(metric)
        out = out | {"<": c < bound, "<=": c <= bound, ">": c > bound, ">=": c >= bound}[how]
    return out


def quality(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """docs plus the measures, base_failed and kept.

    base_failed: under 10 words, or over a fifth of the words in 5-word windows found twice or more.
    kept: not base_failed and no rule of the table rejects. Null and empty texts have no words, so
    they fail. Each row is judged on its own: repeated rows get equal results, ties do not exist.
    """
    d = measure(docs, text_col)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", base).withColumn("kept", ~base & ~compile_rules(rules))
