"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS

# Common function words of the languages that the rules know.
STOP_WORDS = tuple(
    "the of and to in is that it for was with as be by this are from "
    "der die und das den ist nicht ein zu mit von des auf für "
    "le la les des et que un une est pour dans qui en du "
    "el los las de y por con para no se".split()
)
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes while low <= metric <= high (either may be None)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value, out = F.col(self.metric), F.lit(True)
        if self.low is not None:
            out = out & (value >= F.lit(self.low))
        if self.high is not None:
            out = out & (value <= F.lit(self.high))
        return out


#: The thresholds. The first two are the base rules, which the others only add to.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("repeated_windows", "repeat_percent", high=30.0),
    Rule("word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.4),
)
BASE_RULES = ("length", "repeated_windows")


def _repeat_positions(grams: Column) -> Column:
    """Sorted starts of the windows whose hash occurs again in the document."""
    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = F.zip_with(
        F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda a, b: F.struct(a["i"].alias("i"), a["h"].alias("h"), (a["h"] == b["h"]).alias("next"))),
        F.concat(F.array(F.lit(None).cast("bigint")), F.transform(ordered, lambda s: s["h"])),
        lambda a, before: F.when(a["next"] | (a["h"] == before), a["i"]),
    )
    return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id as doc_id and every metric of the rule table.

    A null text has no words. Windows are compared by a 64-bit hash within one document only.
    """
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), WORD_SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(
        F.col(id_col).alias("doc_id"),
        words.alias("words"),
        (F.size(lines)).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        (F.length(F.col(text_col)) - F.length(F.regexp_replace(F.col(text_col), SYMBOLS, ""))).alias("n_symbols"),
    )
    n = F.size("words")
    two = one.select(
        "doc_id",
        "n_lines",
        "n_dup_lines",
        "n_symbols",
        n.alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("grams"),
    )
    starts = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), _repeat_positions(F.col("grams")))
    three = two.select("*", starts.alias("starts")).drop("grams")
    covered = F.aggregate(
        F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )
    whole = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop")]
    four = three.select("doc_id", *whole, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))
    per_word = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0))
    return four.select(
        "*",
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbol_ratio"),
        per_word("n_stop").alias("stop_ratio"),
        F.coalesce(F.lit(100) * F.col("n_repeat_words") / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0)).alias("repeat_percent"),
        F.coalesce(F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)), F.lit(0.0)).alias("dup_line_ratio"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics, base_failed, kept and the array of failed rules, one row for each row of docs, in one projection.

    Null or empty text: no words, so the length rule fails. Repeated rows are judged alike, each on its own.
    An empty table gives an empty table; columns other than the two named are not read.
    """
    base = [r for r in rules if r.name in BASE_RULES]
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | ~r.passes()
    return metrics(docs, id_col, text_col).select("*", base_failed.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", F.size("failed_rules") == 0)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with exactly the columns of docs, whatever they are called."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    judged = judge(packed, rules, id_col="row", text_col="text")
    # a row for each that is kept: a plain filter would be pushed below, with every metric written out in it again
    passed = F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return judged.select("doc_id", F.explode(passed)).select("doc_id.*")
