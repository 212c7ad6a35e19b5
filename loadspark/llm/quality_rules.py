"""Quality rules: a table of thresholds compiled into Spark expressions, no user functions.

`measure` adds counts and ratios of a text, `rule_failures` turns the table into one boolean per rule, and `apply_rules`
does both. A text never leaves its row: there is no shuffle.

Defined results: a null text counts as empty; an empty text has no words and fails the length rule; a text of any length
is read whole (work grows as n log n in its words, and only for texts that repeat a window at all). Repeated rows are
judged alike; an empty table gives no rows. Columns of the input that carry a result's name are replaced, others stay.

Windows are told apart by a 64-bit hash of their three words: two different windows of one text are taken for the same
with a chance of about (words of the text)^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadspark.llm.common import SPACE, WORD, clean_text, words
from loadspark.llm.registry import query, table

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on are as with his they at be this have from or had by but what all were "
    "der die das und ist in zu den von mit sich des auf nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et un une est en que qui dans pour pas sur au avec il elle ce du "
    "el los las y que se del por con para una su no lo como más o ha me si"
).split()
STOP_WORDS = tuple(sorted(set(STOP_WORDS)))

BASE_WORDS = 50
BASE_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """`top` / `bottom` must lie in [low, high]; a bound of None is open, a bottom of zero passes."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.03, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.4),
    Rule("shouting_lines", "n_loud_lines", "n_lines", None, 0.4),
    Rule("line_length", "n_words", "n_lines", 1.5, None),
)

LOUD_LINE = r"(!!|\?\?|\.\.\.)\s*$"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_stop_words", "n_loud_lines")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(w: Column) -> Column:
    """Words inside windows of three that occur twice or more in an array of words."""
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )

    def places(h: Column) -> Column:
        """Starts of repeated windows, found as equal neighbours in hash order."""
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"])),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    none = F.lit(0).cast("long")
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(none))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts in COUNTS and EXTRA (bigint) for each text.

    The counts come out of a generator of one row, below which no later filter on them can be moved, so they are computed
    once per text.
    """
    keep = [c for c in df.columns if c not in COUNTS + EXTRA]
    t = clean_text(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike(LOUD_LINE))).cast("long").alias("n_loud_lines"),
        ),
    )
    all_counts = F.struct(
        of_words.alias("words"),
        of_lines.alias("lines"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    out = df.select(*(F.col(f"`{c}`") for c in keep), F.inline(F.array(all_counts)).alias("__w", "__l", "__c", "__s"))
    return out.select(
        *(F.col(f"`{c}`") for c in keep),
        F.col("__w.n_words").alias("n_words"),
        F.col("__c").alias("word_chars"),
        F.col("__s").alias("n_symbols"),
        F.col("__l.n_dup_lines").alias("n_dup_lines"),
        F.col("__w.n_repeat_words").alias("n_repeat_words"),
        F.col("__l.n_lines").alias("n_lines"),
        F.col("__w.n_stop_words").alias("n_stop_words"),
        F.col("__l.n_loud_lines").alias("n_loud_lines"),
    )


def rule_failed(rule: Rule) -> Column:
    """True where the ratio of a rule is out of bounds, by multiplication so that a bottom of zero passes."""
    top, bottom = F.col(rule.top).cast("double"), F.col(rule.bottom).cast("double")
    out = F.lit(False)
    if rule.low is not None:
        out = out | (top < F.lit(float(rule.low)) * bottom)
    if rule.high is not None:
        out = out | (top > F.lit(float(rule.high)) * bottom)
    return out


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts, `base_failed`, `failed_rules` (names) and `kept`; all rows stay."""
    out = measure(df, text)
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    failed = F.filter(F.array(*(F.when(rule_failed(r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    keep = [c for c in out.columns if c not in ("base_failed", "failed_rules", "kept")]
    return out.select(
        *(F.col(f"`{c}`") for c in keep),
        base.alias("base_failed"),
        failed.alias("failed_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def _rule_sql(rule: Rule) -> str:
    tests = []
    if rule.low is not None:
        tests.append(f"{rule.top}::DOUBLE < {float(rule.low)!r}::DOUBLE * {rule.bottom}::DOUBLE")
    if rule.high is not None:
        tests.append(f"{rule.top}::DOUBLE > {float(rule.high)!r}::DOUBLE * {rule.bottom}::DOUBLE")
    return " OR ".join(tests)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), dup AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id
), c AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in STOP_WORDS)})))::BIGINT AS n_stop_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '{LOUD_LINE}')))::BIGINT AS n_loud_lines
  FROM l LEFT JOIN cov USING (doc_id)
), v AS (
  SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(_rule_sql(r) for r in RULES)}) AS kept
FROM v
"""


@query("op7_quality_rules", ORACLE)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
