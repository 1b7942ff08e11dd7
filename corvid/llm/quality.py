"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import let, words

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where the condition holds (null: it passes). The condition is made when a session is
    there, over the columns of measured(): id, text, w (words), n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words."""

    name: str
    fails: Callable[[], Column]


def _share(condition) -> Column:
    return F.size(F.filter("w", condition)) / F.greatest(F.size("w"), F.lit(1))


#: The production rules: symbols for words, shouted words, stuttered words, repeated lines, few words with letters.
RULES = (
    Rule("symbols", lambda: F.col("n_symbols") > 0.1 * F.col("n_words")),
    Rule("dup_lines", lambda: F.col("n_dup_lines") > 0.5 * F.col("n_lines")),
    Rule("shouted", lambda: _share(lambda x: x.endswith("!!")) > 0.1),
    Rule("stuttered", lambda: let(F.col("w"), lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))) / F.greatest(F.size(w), F.lit(1))) > 0.3),
    Rule("letters", lambda: _share(lambda x: x.rlike(r"\p{L}")) < 0.4),
)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, text (null: empty), words w, and the base figures of the whole text; no shuffle."""
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = out.select("id", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select("id", "text", "w", lines.alias("lines"), let(F.transform("w", lambda x: F.xxhash64(x)), _windows).alias("g"))
    return out.select(
        "id", "text", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("g")) == F.size("g"), F.lit(0)).otherwise(_covered("g")).cast("long").alias("n_repeat_words"),
    )


def _windows(h: Column) -> Column:
    """Hashes of all runs of WINDOW words, from the hashes of the words."""
    spans = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    return F.when(F.size(h) >= WINDOW, spans).otherwise(F.array().cast("array<bigint>"))


def _covered(spans: str) -> Column:
    """Words that lie in windows found twice or more: windows sorted with their places, those equal to a neighbour
    kept, and the overlap of successive places taken off."""
    placed = F.sort_array(F.transform(F.col(spans), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def places(s):
        again = F.filter(s, lambda p, k: F.get(s, k - 1)["x"].eqNullSafe(p["x"]) | F.get(s, k + 1)["x"].eqNullSafe(p["x"]))
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    def width(p):
        gaps = F.transform(p, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return let(let(placed, places), width)


def ordered_rules(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = 400, sample_chars: int = 100_000) -> list[Rule]:
    """The rules by rejection per cost, best first, from their time and share of rejects on a bounded sample: the first
    sample_rows texts of up to sample_chars characters, which take up only as many files as they need.

    Only the order depends on the sample: a document's verdict is the same under every order."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    texts = docs.select(text.alias("text")).filter(F.length("text") <= sample_chars).limit(sample_rows).collect()
    sample = measured(spark.createDataFrame([(0, r.text) for r in texts], "id int, text string").coalesce(1), "id")

    def timed(condition) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            n, k = sample.agg(F.count(F.lit(1)), F.count_if(condition)).first()
            best, share = min(best, time.perf_counter() - began), k / max(n, 1)
        return best, share

    nothing = timed(F.lit(False))[0]
    found = [(share / max(cost - nothing, 1e-4), rule) for rule in rules for cost, share in [timed(rule.fails())]]
    return [rule for _, rule in sorted(found, key=lambda x: -x[0])]


def cascade(rules) -> Column:
    """The name of the first rule that a document fails, null if none; later rules aren't evaluated."""
    out = None
    for rule in rules:
        out = F.when(rule.fails(), F.lit(rule.name)) if out is None else out.when(rule.fails(), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def quality_verdicts(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, repeat_percent: int = 20, sample_rows: int = 400) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule.

    base_failed: fewer than min_words words, or 100 * n_repeat_words > repeat_percent * n_words. kept: neither that
    nor a rule of the cascade. Null, empty and blank texts have no words and fail; null ids and repeated rows stay as
    they are; other columns of the input are ignored; an empty table gives an empty result. One pass, no shuffle.
    """
    figures = measured(docs, id_col, text_col)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    first = F.when(base, F.lit("base")).otherwise(cascade(ordered_rules(docs, rules, text_col, sample_rows)))
    out = figures.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), first.alias("failed_rule"))
    return out.withColumn("kept", F.col("failed_rule").isNull())


def keep_good(docs: DataFrame, rules=RULES, text_col: str = "text", min_words: int = 10, repeat_percent: int = 20, sample_rows: int = 400) -> DataFrame:
    """The rows whose text passes, with all their columns: the same cascade as a filter, without a join."""
    marked = docs.withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    figures = measured(marked, "__row", text_col)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    good = ~base & cascade(ordered_rules(docs, rules, text_col, sample_rows)).isNull()
    # no filter moves below a row number that it uses: pushed down, the condition would compute each figure many times
    judged = figures.select("id", good.alias("good"), F.monotonically_increasing_id().alias("at"))
    return judged.filter("good AND at >= 0").select("id.*")
