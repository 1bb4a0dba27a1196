"""Quality rules as a bitmask ledger, on built-in functions only.

Every rule is evaluated once a document. The ledger keeps the measurements and one
long of failure bits; policies are versioned masks over those bits, so a policy
change or an ablation never reads a text again.

Defined cases: null or empty text has no words and fails min_words alone; repeated
rows are judged row by row; an empty table gives no rows; other columns of the
input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document fails where the condition, SQL over the measurements, holds."""

    name: str
    fails: str


#: Bit i of a ledger row belongs to rule i. Only ever append: old ledgers keep their meaning.
RULES = (
    Rule("min_words", "n_words < 10"),
    Rule("repeat_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("dup_lines", "n_dup_lines > 0 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "n_words >= 10 and word_chars < 2 * n_words"),
    Rule("long_words", "n_words >= 10 and word_chars > 20 * n_words"),
)

#: Versioned policies: the rules whose failure removes a document.
POLICIES = {
    1: ("min_words", "repeat_words"),
    2: ("min_words", "repeat_words", "symbols", "dup_lines", "short_words", "long_words"),
}
POLICY = 2


def mask(rules: tuple[str, ...]) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[name] for name in rules)


def _held(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column that is computed once, however often functions over arrays refer to it."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements.

    Five-word windows are compared as joined words. Where all of a text's windows
    differ, which one pass over them tells, nothing more is done; otherwise equal
    windows meet by sorting, and the words under their union are counted.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    df = _held(df, "words", F.expr(rf"regexp_extract_all(text, '{WORD}', 0)".replace("\\", "\\\\")))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)),
            lambda i: F.array_join(F.slice("words", i, F.lit(WINDOW)), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))
    df = _held(df, "windows", windows)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).alias("windows"),
    )
    placed = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    df = df.select("*", F.explode(F.array(F.sort_array(placed))).alias("placed")).drop("windows")
    same = F.filter(
        F.transform(
            "placed",
            lambda x, k: F.when(
                (F.get("placed", k + 1)["w"] == x["w"]) | ((k > 0) & (F.get("placed", k - 1)["w"] == x["w"])), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(same),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct(
            (s["n"] + i + WINDOW - F.greatest(i, s["end"])).cast("long").alias("n"), (i + WINDOW).alias("end")
        ),
        lambda s: s["n"],
    )
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("placed").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and fail_bits: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(0).cast("long"))
    return measured(docs).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: int = POLICY) -> DataFrame:
    """Adds kept and policy_version to ledger rows; reads bits only."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0).withColumn(
        "policy_version", F.lit(version)
    )


def ablations(rows: DataFrame, version: int = POLICY) -> DataFrame:
    """For each rule of a policy: how many fail it, and how many would be kept without it.

    One pass: bits are counted per distinct mask first, and there are at most
    2**rules of those.
    """
    rules = POLICIES[version]
    whole = mask(rules)
    by_mask = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit")) for r in rules]))
    return (
        by_mask.select("bits", "n", each.alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(
                F.when(F.col("bits").bitwiseAND(F.lit(whole) - F.col("r.bit")) == 0, F.col("n")).otherwise(0)
            ).alias("n_kept_without"),
        )
    )


def op6_rule_ledger(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy."""
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[1]))) != 0
    return rows.select("doc_id", *MEASURES, base.alias("base_failed"), "kept", "fail_bits", "policy_version")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), win AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(dup.n_lines, 0) AS n_lines
  FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)
), b AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
    + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (n_dup_lines > 0 AND 10 * n_dup_lines > 3 * n_lines)::INT
    + 16 * (n_words >= 10 AND word_chars < 2 * n_words)::INT
    + 32 * (n_words >= 10 AND word_chars > 20 * n_words)::INT)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 2::INT AS policy_version
FROM b
"""
