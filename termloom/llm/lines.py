"""Line deduplication by winnowing over line hashes.

A document is a sequence of lines with a word. Of every MIN_RUN consecutive lines the
one of least hash, the leftmost of equals, is a fingerprint, so two equal runs of so
many lines have the same fingerprint at the same place: none is missed. Only
fingerprints are shuffled at first. Where one occurs more than once, the matches are
extended both ways: all runs of MIN_RUN lines around it are compared, by two hashes
of their lines, and each but the first (by doc_id, then place) is a later repeat.
Overlapping repeats grow together to runs of any length, whose lines are deleted.
A line of LONG_WORDS words or more is a passage of its own: it is a run by itself,
whatever its neighbours, and its own hash is its fingerprint.

Defined cases: null or empty text has no lines and stays as it is; lines without a
word are not compared and stay; a text of fewer lines than a run stays but for its long lines; a document
whose every line is deleted becomes empty, or is dropped on request; of repeated
rows the first by key stays; a null doc_id sorts first; an empty table gives no
rows; columns of the input are returned as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import written

MIN_RUN = 2
#: Words from which a single line is a run.
LONG_WORDS = 50


def _word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _long(line: Column) -> Column:
    # so many words have a letter each and a space between
    return (F.length(line) >= 2 * LONG_WORDS - 1) & (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= LONG_WORDS)


def line_hashes(docs: DataFrame) -> DataFrame:
    """row, doc_id, the hashes a, b of each line with a word, in order, and the places of long lines."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), _word)
    one = F.transform(lines, lambda x: F.xxhash64(x))
    two = F.transform(lines, lambda x: F.xxhash64(F.lit(7), x, F.lit("b")))
    long = F.filter(F.transform(lines, lambda x, i: F.when(_long(x), i)), lambda i: i.isNotNull())
    return docs.select("row", "doc_id", one.alias("a"), two.alias("b"), long.alias("long")).where(F.size("a") >= 1)


def _windows(df: DataFrame, run: int) -> DataFrame:
    """Adds win: for each start of run lines, the place of its least hash and that hash; long lines are runs of one."""
    least = lambda i: F.array_min(F.slice("a", i, F.lit(run)))
    one = lambda start, print_, at, n: F.struct(start.alias("start"), print_.alias("print"), at.alias("at"), F.lit(n).alias("n"))
    several = F.transform(
        F.sequence(F.lit(1), F.size("a") - (run - 1)),
        lambda i: one(i - 1, least(i), (i - 2 + F.array_position(F.slice("a", i, F.lit(run)), least(i))), run),
    )
    single = F.transform("long", lambda i: one(i, F.xxhash64(F.lit(3), F.get("a", i)), i.cast("long"), 1))
    some = F.when(F.size("a") >= run, several)
    return df.where((F.size("a") >= run) | (F.size("long") > 0)).withColumn("win", F.concat(F.coalesce(some, F.array()), single))


def later_repeats(docs: DataFrame, run: int = MIN_RUN) -> DataFrame:
    """(row, starts): starts and lengths of runs of lines that occurred earlier, of docs (row, doc_id, text)."""
    hashed = written(_windows(line_hashes(docs), run), "lines")
    prints = hashed.select(F.explode(F.array_distinct(F.transform("win", lambda w: F.struct(w["print"], w["at"])))).alias("p"))
    shared = prints.groupBy("p.print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    line = lambda c, k: F.get(c, F.col("w.start") + k)
    hashed_run = lambda seed, c: F.when(F.col("w.n") == run, F.xxhash64(F.lit(seed), *[line(c, k) for k in range(run)])).otherwise(
        F.xxhash64(F.lit(seed + 2), line(c, 0))
    )
    wide = hashed.select("row", "doc_id", F.explode("win").alias("w"), "a", "b").select(
        "row",
        "doc_id",
        F.col("w.start").alias("start"),
        F.col("w.print").alias("print"),
        F.col("w.n").alias("n"),
        hashed_run(1, "a").alias("h1"),
        hashed_run(2, "b").alias("h2"),
    )
    met = written(wide.join(shared, "print", "left_semi").drop("print"), "met")
    place = F.struct("doc_id", "row", "start")
    first = met.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("met")).where("met > 1").drop("met")
    return (
        met.join(first, ["h1", "h2"])
        .where(~place.eqNullSafe(F.col("first")))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("starts"))
    )


def dedup_lines(docs: DataFrame, *, run: int = MIN_RUN, drop_emptied: bool = False) -> DataFrame:
    """docs with the lines of later repeated runs deleted from text; other columns as they were."""
    columns = docs.columns
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    key = F.xxhash64(doc, text, *[F.col(c) for c in columns if c not in ("doc_id", "text")])
    keyed = docs.select(F.struct(*columns).alias("own"), doc.alias("doc_id"), key.alias("key"))
    text = F.col("own")["text"].cast("string")
    # equal rows are told apart by their number, which is counted among the equal ones alone
    same = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    if same.isEmpty():
        numbered = keyed.withColumnRenamed("key", "row")
    else:
        nth = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
        numbered = written(keyed.withColumn("row", F.xxhash64("key", nth)).drop("key"), "numbered")
    starts = written(later_repeats(numbered.select("row", "doc_id", text.alias("text")), run), "starts")
    # one plan at every size: both sides are dealt by row
    joined = numbered.drop("doc_id").join(starts.hint("merge"), "row", "left")
    lines = F.split(text, "\n")
    numbered_lines = F.transform(lines, lambda x, i: F.when(_word(x), i))
    gone = F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    placed = joined.where("starts is not null").select(
        "own",
        F.explode(F.array(F.struct(lines.alias("all"), F.filter(numbered_lines, lambda i: i.isNotNull()).alias("at")))).alias("l"),
        F.array_distinct(gone).alias("gone"),
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("l.all") - 1), F.transform("gone", lambda g: F.get("l.at", g)))
    kept = F.transform(F.col("kept"), lambda i: F.get("l.all", i))
    changed = placed.select("own", "l", F.explode(F.array(left)).alias("kept")).select(
        "own", F.array_join(kept, "\n").alias("text"), F.exists(kept, _word).alias("some")
    )
    if drop_emptied:
        changed = changed.where("some")
    untouched = joined.where("starts is null").select("own", text.alias("text"))
    both = untouched.unionByName(changed.select("own", "text"))
    return both.select(*[F.col("text") if c == "text" else F.col("own")[c].alias(c) for c in columns])


def op2_winnow_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with later repeats of runs of two or more lines, or of a long line, deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_lines(docs.select("doc_id", "text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), _word)
    return out.select("doc_id", F.size(words).cast("long").alias("n_lines_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT r, doc_id, p, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS w
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS p FROM d)
), n AS (
  SELECT *, sum(w::INT) OVER (PARTITION BY r ORDER BY p) - 1 AS i FROM l
), pairs AS (
  SELECT r, doc_id, i, line, lead(line) OVER (PARTITION BY r ORDER BY i) AS next FROM n WHERE w
), later AS (
  SELECT r, i FROM (
    SELECT r, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, r, i) AS k FROM pairs WHERE next IS NOT NULL
  ) WHERE k > 1
), long AS (
  SELECT r, i FROM (
    SELECT r, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, r, i) AS k FROM pairs
    WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50
  ) WHERE k > 1
), gone AS (
  SELECT r, i + k AS i FROM later, (SELECT unnest([0, 1]) AS k) UNION SELECT r, i FROM long
), kept AS (
  SELECT n.r, n.p, n.line, n.w FROM n LEFT JOIN gone ON n.r = gone.r AND n.i = gone.i AND n.w WHERE gone.r IS NULL
), t AS (
  SELECT r, string_agg(line, chr(10) ORDER BY p) AS text, sum(w::INT)::BIGINT AS c FROM kept GROUP BY r
)
SELECT d.doc_id, coalesce(t.c, 0)::BIGINT AS n_lines_kept, sha256(coalesce(t.text, '')) AS text_sha256
FROM d LEFT JOIN t USING (r)
"""
