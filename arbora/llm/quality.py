"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import WORD, text_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it that was for on are as with by this be at or from not he his but they you she an "
    "der die das und ist im den von zu mit sich des auf für nicht ein eine als auch es dem sie wie aus bei "
    "le la les de du et est un une que qui dans pour pas sur au aux en ce il elle ne se son avec "
    "el los las y del por con para una su lo como más pero sus al ha no si"
).split()
#: Words in a window of which repeats are counted.
WINDOW = 5


class Rule(NamedTuple):
    """``numerator / denominator`` must lie in [low, high]; None leaves that end open.

    ``slack`` is added to the numerator for the lower bound, so that short texts may lack it.
    """

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None
    slack: int = 0


#: Base rules of the contract: at least 10 words, at most 20 % of them in repeated windows.
BASE = (Rule("length", "n_words", "one", 10, None), Rule("repeated words", "n_repeat_words", "n_words", None, 0.2))
#: Rules of this operator's own. They are wide on purpose: prose of any of the four languages passes.
RULES = (
    Rule("word length", "word_chars", "n_words", 2, 20),
    Rule("symbols", "n_symbols", "n_words", None, 0.3),
    Rule("stop words", "n_stop_words", "n_words", 0.02, None, 1),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """All rules as one boolean column, without division: numerator against bound * denominator."""
    held = F.lit(True)
    for r in rules:
        if r.low is not None:
            held &= F.col(r.numerator) + r.slack >= F.lit(float(r.low)) * F.col(r.denominator)
        if r.high is not None:
            held &= F.col(r.numerator) <= F.lit(float(r.high)) * F.col(r.denominator)
    return held


def repeated_words(hashes: str, n: str) -> list[tuple[str, Column]]:
    """Steps that end in n_repeat_words: words in windows found twice or more in the text.

    Each window is one 64-bit hash of its words' hashes and the place it starts at. Sorted, equal
    windows are neighbours, so the places of repeated ones come from one pass, and the words
    they cover from the gaps between the sorted places: O(n log n) for any text, however often
    it repeats itself.
    """
    h = F.col(hashes)
    at = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW)))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    grams = F.when(F.col(n) >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col(n) - WINDOW).cast("int")), lambda i: F.struct(at(i).alias("h"), i.alias("i")))).otherwise(none)
    pair = lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    s, p = F.col("__sorted"), F.col("__places")
    return [
        ("__sorted", F.sort_array(grams)),
        ("__places", F.sort_array(F.array_distinct(F.flatten(F.filter(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), pair), lambda x: x.isNotNull()))))),
        ("n_repeat_words", F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda a, x: a + x).cast("long")),
    ]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures that rules may name, one projection over each whole text.

    Null texts have no words and count as empty. Columns of ``docs`` named like a measure are
    replaced. Very long texts are measured whole, in time n log n of their words. Rows that repeat are all
    measured, an empty table gives none.
    """
    words, text = F.col("__words"), text_of(text_col)
    steps: list[tuple[str, Column]] = [
        ("__words", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))),
        ("__hashes", F.transform(words, lambda w: F.xxhash64(w))),
        ("n_words", F.size(words).cast("long")),
        ("one", F.lit(1).cast("long")),
        ("word_chars", F.length(F.array_join(words, "")).cast("long")),
        ("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")),
        ("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))),
        ("n_lines", F.size("__lines").cast("long")),
        ("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")),
        ("n_stop_words", F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long")),
        *repeated_words("__hashes", "n_words"),
    ]
    out = docs
    for name, value in steps:
        out = out.withColumn(name, value)
    return out.drop(*(n for n, _ in steps if n.startswith("__")))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text_col: str = "text") -> DataFrame:
    """``measure`` and base_failed, kept: never null, whatever is null in ``docs``.

    Texts without words fail the base rules. Rows, also ones that repeat, are judged one by one; what lies on a
    bound is within it. An empty table gives none.
    """
    return measure(docs, text_col).withColumn("base_failed", ~compiled(base)).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The rows of ``docs`` that pass, with all columns of ``docs`` unchanged, also those named like a measure.

    Null, empty and very long texts are judged as judge() does; rows that repeat stay or go together.
    The filter also reads the partition's number, as Spark moves no filter below a projection that
    has it: moved, the filter would repeat the measures once for each place that they are used.
    """
    wide = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))
    return judge(wide, rules, base).withColumn("__at", F.spark_partition_id()).where("kept and __at >= 0").select("__row.*")
