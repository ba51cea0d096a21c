"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Every rule names a measure of the text and the range in which it passes. The measures are lengths, symbol, stop-word
and line ratios, computed from arrays of words and lines inside the scan stage: no user function, no shuffle.

Cases: a null or empty text has no words, every count is 0, and it fails the base rule; ratios over nothing are 0;
repeated rows are judged each for itself; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SYMBOLS = "#*$%&|<>"
#: up to so many repeated windows of a text are searched instead of sorted
SEARCHED = 64
#: fixed values: frequent function words of the four languages
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by this had not are but from or have an they which one you "
    "de la que el en los se del las por un con una su para es al lo como le les des et est dans du au pour pas sur ce "
    "der die und den von das mit sich dem ein nicht eine auf ist im zu").split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; a missing bound is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: the threshold table in production
RULES = (
    Rule("n_words", 50, 100_000),
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.30),
    Rule("short_line_ratio", None, 0.80),
    Rule("repeat_word_ratio", None, 0.50),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _without(text: Column, characters: str, by: str = "") -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _covered(grams: Column, twice: Column) -> Column:
    """The number of words inside windows whose hash is among those found twice.

    A short list of repeated hashes is searched; with a long one the windows are sorted, so that equal hashes lie side
    by side. Both give the same positions.
    """
    searched = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(twice, g), i)), lambda i: i.isNotNull())
    in_order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    neighbours = F.zip_with(in_order, F.slice(in_order, 2, F.greatest(F.size(in_order) - 1, F.lit(1))),
                            lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    sorted_out = F.flatten(F.filter(neighbours, lambda x: x.isNotNull()))
    positions = F.when(F.size(twice) <= SEARCHED, searched).otherwise(sorted_out)
    words = F.array_distinct(F.flatten(F.transform(positions, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(F.size(twice) == 0, F.lit(0)).otherwise(F.size(words))


def measures(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and ratios. Three-word windows are compared by their 64-bit hash."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    arrays = source.select(
        "doc_id", F.array_remove(F.split(_without(F.col("t"), "\t\n\x0b\f\r", " "), " "), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.trim(_without(x, "\t\x0b\f\r", " ")) != "").alias("lines"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).alias("n_symbols"))
    n = F.size("w")
    following = lambda by: F.slice("w", by + 1, F.greatest(n - by, F.lit(0)))
    hashed = F.zip_with(F.zip_with("w", following(1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), following(2),
                        lambda p, c: F.xxhash64(p["a"], p["b"], c))
    counted = arrays.select(
        "doc_id", n.cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), "n_symbols",
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.length(x) < 30)).alias("n_short_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop_words"),
        # the last two windows have no third word
        F.slice(hashed, 1, F.greatest(n - 2, F.lit(0))).alias("grams"))
    ordered = counted.withColumn("s", F.sort_array("grams"))
    after = F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0)))
    equal = F.filter(F.zip_with("s", after, lambda a, b: F.when(a == b, a)), lambda g: g.isNotNull())
    found = ordered.withColumn("twice", F.array_distinct(equal))
    counts = found.select(
        "doc_id", "n_words", *[F.col(c).cast("bigint").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines")],
        _covered(F.col("grams"), F.col("twice")).cast("bigint").alias("n_repeat_words"),
        "n_lines", "n_short_lines", "n_stop_words")
    words, all_lines = F.col("n_words"), F.col("n_lines")
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _ratio(F.col("word_chars"), words).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        _ratio(F.col("n_stop_words"), words).alias("stop_word_ratio"),
        _ratio(F.col("n_dup_lines"), all_lines).alias("dup_line_ratio"),
        _ratio(F.col("n_short_lines"), all_lines).alias("short_line_ratio"),
        _ratio(F.col("n_repeat_words"), words).alias("repeat_word_ratio"))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one condition."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (F.col(rule.measure) >= rule.low)
        if rule.high is not None:
            verdict = verdict & (F.col(rule.measure) <= rule.high)
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ratios, the base rule and the verdict of the table, one row per document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs).withColumns({"base_failed": failed, "kept": ~failed & passes(rules)})
