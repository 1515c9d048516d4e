"""Quality rules: a table of thresholds, compiled into one Spark projection (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import columns_of, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "it", "on", "was", "as", "by", "this", "from", "are",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "im", "auf", "nicht", "sich", "ein", "eine", "dem", "als",
    "le", "la", "les", "de", "des", "et", "du", "un", "une", "est", "en", "que", "qui", "dans", "pour", "par", "sur", "pas",
    "el", "los", "las", "y", "por", "con", "una", "se", "del", "no", "para", "al", "su",
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A ratio that must stay within [low, high]; None leaves a side open. A null ratio passes."""

    name: str
    low: float | None = None
    high: float | None = None


#: The table of thresholds; the names are those of ratios().
RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.50),
    Rule("capital_ratio", None, 0.50),
    Rule("words_per_line", 1.5, None),
)
MIN_WORDS, REPEAT_PERCENT = 50, 50


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and the counts that the rules rest on, in native expressions only.

    n_words, word_chars (code points in words), n_symbols, n_lines and n_dup_lines (\\n-split lines with a word; those equal
    to an earlier one), n_repeat_words (words inside 3-word windows
    that occur twice or more), n_stop (stop words in lower case or with a capital), n_capital (upper-case letters). Null texts count as empty. Every
    text is measured whole.

    Repeated windows: each window becomes one long, its hash above its position. Sorted, equal hashes are neighbours, and
    the positions come with them. A text of n words leaves 64 - log2(n) bits to the hash (54 bits for 540 words).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*keep, text.alias("_text")).withColumn("_words", words(F.col("_text"))).withColumn("_n", F.size("_words"))
    bits = F.ceil(F.log2(F.greatest(F.col("_n"), F.lit(2)).cast("double") + 1)).cast("int")
    step = step.withColumn("_bits", bits)
    packed = F.expr(
        "case when _n >= 3 then sort_array(transform(sequence(0, _n - 3), i -> "
        "shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits) | cast(i as bigint))) else array() end"
    )
    step = step.withColumn("_packed", packed)
    doubled = F.expr(
        "transform(filter(sequence(0, greatest(size(_packed) - 1, 0)), i -> size(_packed) > 1 and ("
        "(i > 0 and shiftright(_packed[i], _bits) = shiftright(_packed[i - 1], _bits)) or "
        "(i + 1 < size(_packed) and shiftright(_packed[i], _bits) = shiftright(_packed[i + 1], _bits)))), "
        "i -> cast(_packed[i] & (shiftleft(1L, _bits) - 1L) as int))"
    )
    step = step.withColumn("_at", F.sort_array(doubled))
    covered = F.expr(
        "case when size(_at) = 0 then 0 else aggregate(sequence(0, size(_at) - 1), 0, "
        "(acc, i) -> acc + case when i + 1 < size(_at) then least(3, _at[i + 1] - _at[i]) else 3 end) end"
    )
    step = step.withColumn("_lines", F.expr("filter(split(_text, '\\n', -1), x -> length(trim(' \\t\\n\\x0B\\f\\r', x)) > 0)".replace("\\x0B", "\x0b")))
    stop = ", ".join(f"'{form}'" for w in STOP_WORDS for form in dict.fromkeys((w, w.capitalize())))
    return step.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.expr(f"size(filter(_words, w -> w in ({stop})))").cast("long").alias("n_stop"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capital"),
    )


def ratios() -> dict[str, Column]:
    """The quotients that rules may name, over the columns of measures(); null where there is nothing to divide by."""
    n = F.col("n_words")
    return {
        "mean_word_length": F.try_divide(F.col("word_chars"), n),
        "symbols_per_word": F.try_divide(F.col("n_symbols"), n),
        "stop_word_ratio": F.try_divide(F.col("n_stop"), n),
        "dup_line_ratio": F.try_divide(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_ratio": F.try_divide(F.col("n_repeat_words"), n),
        "capital_ratio": F.try_divide(F.col("n_capital"), F.col("word_chars")),
        "words_per_line": F.try_divide(n, F.col("n_lines")),
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: all rules hold."""
    known, verdict = ratios(), F.lit(True)
    for rule in rules:
        ratio = known[rule.name]
        if rule.low is not None:
            verdict = verdict & F.coalesce(ratio >= rule.low, F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(ratio <= rule.high, F.lit(True))
    return verdict


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: its counts, base_failed and kept. Null, empty and blank texts fail the base rule.

    base_failed: under MIN_WORDS words, or over REPEAT_PERCENT per cent of the words stand in repeated windows.
    Extra columns are left out; repeated rows and null ids are judged as any others; an empty table gives an empty one.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (
        measures(docs, keep)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    )


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names.

    The partition id makes the verdict a column that no predicate is pushed through. Pushed down, the verdict would spell out
    all measures anew at each place where it names them.
    """
    whole = docs.select(F.struct(*columns_of(docs)).alias("_row"), "text")
    verdicts = quality_verdicts(whole, rules, keep=("_row",))
    return verdicts.select("_row", (F.col("kept") & (F.spark_partition_id() >= 0)).alias("_keep")).where("_keep").select("_row.*")
