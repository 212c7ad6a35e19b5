"""Secret scans: fixed patterns, and character Markov models for what has no pattern.

Two first-order character models are trained, one on random strings and one on ordinary identifiers; both samples are
labelled by how they are made: random strings are digests in several encodings, ordinary identifiers are words of
documents outside every fixed pattern (about TRAIN_DOCS documents, picked by a hash of their key). A run of 20 or more
key characters is a secret of kind `random` if the mean log-likelihood ratio of its transitions exceeds MIN_RATIO.

Everything is Spark expressions. A text is split by a pattern in place; only the lengths of matches and of the gaps between
them leave the row, and running totals of those lengths give the positions, so the work stays linear in a text's length.
Equal texts share their spans, so a large group of copies is totalled once.

Defined results: a null or empty text has no spans; spans are code points, end exclusive; spans of different kinds may
overlap; repeated rows keep their rows; columns named like results are replaced; an empty table gives no rows; long texts are
matched whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loadspark.llm.common import clean_text
from loadspark.llm.registry import query, table
from loadspark.session import materialise

#: Kinds in order; the first three are fixed patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 12
#: Lower-case words without which ASSIGN cannot match.
ASSIGN_WORDS = ("passw", "secret", "token", "api")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
WIDTH = len(ALPHABET) + 1
TRAIN_DOCS = 2000
RANDOM_ROWS = 2000
MIN_RATIO = 0.4
SMOOTHING = 0.5
SEED = 11
MASK = "[SECRET]"
MARKS = "array<struct<kind:int,gap:int,len:int,ok:boolean>>"


def _letters(run: Column) -> Column:
    """Places of a run's characters in the alphabet, 0 for others."""
    return F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(runs: DataFrame) -> dict[tuple[int, int], int]:
    """Transition counts of a column `run`; at most WIDTH^2 rows reach the driver."""
    steps = runs.select(_letters(F.col("run")).alias("x")).select(
        F.explode(
            F.zip_with("x", F.slice("x", 2, F.size("x")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        ).alias("step")
    )
    counted = steps.where("step.b IS NOT NULL").groupBy("step.a", "step.b").count().collect()
    return {(r["a"], r["b"]): r["count"] for r in counted}


def random_strings(spark: SparkSession, rows: int = RANDOM_ROWS, seed: int = SEED) -> DataFrame:
    """Random strings by construction: digests as hexadecimal, base64, letters and digits, and capitals and digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 512)
    coded = F.base64(F.unhex(digest))
    plain = F.regexp_replace(coded, "[^A-Za-z0-9]", "")
    kinds = F.array(F.substring(digest, 1, 40), F.substring(coded, 1, 40), F.substring(plain, 1, 40),
                    F.substring(F.upper(plain), 1, 20))
    return spark.range(rows).select(F.explode(kinds).alias("run"))


def ordinary_identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text", docs_wanted: int = TRAIN_DOCS) -> DataFrame:
    """Identifiers of a hashed part of the documents, outside the fixed patterns, over the alphabet of RUN.

    Words of 6 or more letters, digits and underscores as they stand, and every three plain words in a row as people join
    them: as a path, with hyphens, with underscores, and in camel case.
    """
    part = min(1.0, docs_wanted / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 20)) < int(part * (1 << 20)))
    rest = clean_text(text)
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    alone = F.regexp_extract_all(rest, F.lit("[A-Za-z0-9_]{6,}"), F.lit(0))
    plain = F.filter(F.split(rest, "[^A-Za-z]+"), lambda w: F.length(w) > 1)
    threes = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size("plain") - 2, F.lit(1))), lambda i: i % 3 == 1), lambda i: F.slice("plain", i, 3)
    )
    camel = F.transform("threes", lambda w: F.array_join(F.transform(w, F.initcap), ""))
    joined = [F.expr(f"transform(threes, w -> array_join(w, '{by}'))") for by in "/-_"]
    rows = picked.select(alone.alias("alone"), plain.alias("plain")).withColumn("threes", threes)
    return rows.select(F.explode(F.concat("alone", camel, *joined)).alias("run"))


def fit(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition (row: from, column: to), from two labelled columns `run`."""
    samples = [_pairs(random), _pairs(ordinary)]
    logs = []
    for counts in samples:
        sums = [0] * WIDTH
        for (a, _), n in counts.items():
            sums[a] += n
        logs.append(
            [
                math.log((counts.get((a, b), 0) + SMOOTHING) / (sums[a] + SMOOTHING * WIDTH))
                for a in range(WIDTH)
                for b in range(WIDTH)
            ]
        )
    return [round(x - y, 6) for x, y in zip(*logs, strict=True)]


def log_ratio(run: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a run's transitions."""
    table_of = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    x = _letters(run)
    steps = F.zip_with(
        x, F.slice(x, 2, F.length(run)), lambda a, b: F.coalesce(F.get(table_of, a * WIDTH + b), F.lit(0.0))
    )
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.length(run) - 1, F.lit(1))


def _marks(text: Column, kind: int, pattern: str, ok=None, value: Column | None = None) -> Column:
    """Matches of one kind in order: length of the gap before, of the match, and whether it counts."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    other = hits if value is None else value
    both = F.zip_with(hits, other, lambda h, v: F.struct(h.alias("h"), v.alias("v")))
    found = F.zip_with(
        both,
        F.split(text, pattern, -1),
        lambda m, gap: F.struct(
            F.lit(kind).alias("kind"),
            F.length(gap).alias("gap"),
            F.length(m["h"]).alias("len"),
            (F.lit(True) if ok is None else ok(m["v"])).alias("ok"),
        ),
    )
    return F.filter(found, lambda m: m["len"].isNotNull()).cast(MARKS)


def mark(df: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """Add `__marks`, the matches of all kinds, and `__digest` of texts that have any."""
    t = clean_text(text)
    none = F.array().cast(MARKS)
    low = F.lower(t)
    maybe = F.lit(False)
    for word in ASSIGN_WORDS:
        maybe = maybe | low.contains(word)
    value = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    marks = F.concat(
        F.when(maybe, _marks(t, 0, ASSIGN, lambda v: F.length(v) >= MIN_VALUE, value)).otherwise(none),
        F.when(t.contains("AKIA"), _marks(t, 1, ACCESS)).otherwise(none),
        F.when(t.rlike(HEX), _marks(t, 2, HEX)).otherwise(none),
        F.when(t.rlike(RUN), _marks(t, 3, RUN, lambda v: log_ratio(v, model) > MIN_RATIO)).otherwise(none),
    )
    marked = df.withColumn("__marks", marks)
    return marked.withColumn("__digest", F.when(F.exists("__marks", lambda m: m["ok"]), F.md5(t.cast("binary"))))


def spans_by_digest(marked: DataFrame) -> DataFrame:
    """Spans (start, kind, end) per text that has any, and the ends of what lies before each, for masking."""
    one = marked.where("__digest IS NOT NULL").groupBy("__digest").agg(F.first("__marks").alias("m"))
    rows = one.select("__digest", F.posexplode("m").alias("at", "m")).select("__digest", "at", "m.*")
    before = Window.partitionBy("__digest", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).where("ok")
    placed = placed.select("__digest", (F.col("end") - F.col("len")).alias("start"), "kind", "end")
    earlier = Window.partitionBy("__digest").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    covered = placed.withColumn("free", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("long")))
    return covered.groupBy("__digest").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "free"))).alias("spans")
    )


SPANS = "array<struct<start:bigint,kind:int,end:bigint,free:bigint>>"


def scan(df: DataFrame, model: list[float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with `spans` (start, kind, end and `free`, where the text before was last covered)."""
    kept = [c for c in (df.columns if keep is None else keep) if c != "spans"]
    stored = materialise(mark(df, model, text).select(*(f"`{c}`" for c in kept), "__marks", "__digest"))
    plain = stored.where("__digest IS NULL").select(*(f"`{c}`" for c in kept), F.array().cast(SPANS).alias("spans"))
    found = stored.where("__digest IS NOT NULL").drop("__marks").join(spans_by_digest(stored), "__digest")
    return plain.unionByName(found.select(*(f"`{c}`" for c in kept), F.col("spans").cast(SPANS)))


def redact(df: DataFrame, model: list[float], text: str = "text", mask: str = MASK) -> DataFrame:
    """The same rows and columns with every run of covered characters replaced by the mask."""
    out = scan(df, model, text)
    cuts = F.filter("spans", lambda s, i: (s["start"] > s["free"]) | ((s["start"] == 0) & (i == 0)))
    head = F.transform(cuts, lambda s: F.substr(F.col(text), (s["free"] + 1).cast("int"), (s["start"] - s["free"]).cast("int")))
    tail = F.substr(F.col(text), F.array_max(F.transform("spans", lambda s: s["end"])).cast("int") + 1)
    clean = F.when(F.size("spans") == 0, F.col(text)).otherwise(
        F.concat(F.array_join(head, mask), F.lit(mask), tail)
    )
    return out.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[float]:
    """The model from generated random strings and the documents' ordinary identifiers."""
    return fit(random_strings(docs.sparkSession), ordinary_identifiers(docs, key, text))


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, train(docs), keep=["doc_id"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(named(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )
