"""Readers: tables, text interchange files, and the logical tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(docs: DataFrame) -> DataFrame:
    """pid, doc_id, pos, text: the lines of documents (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("pid"), "doc_id", "pos", "text"
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, paragraphs, headings, links: what page_paragraphs(), headings() and the distinct links() of a page give, as arrays in its row."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), F.lit(1))
    heads = F.regexp_extract_all("html", F.lit(r"<h[1-6]>([^<]*)"), F.lit(1))
    names = F.array_distinct(F.transform(found, tx.entity_name))
    return pages.select("page_id", F.coalesce(_paragraphs(), none).alias("paragraphs"), F.coalesce(heads, none).alias("headings"), F.coalesce(names, none).alias("links"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, name: the targets of a page's site links, normalised."""
    found = F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("name")).select("page_id", tx.entity_name("name").alias("name"))


#: A tag's attributes, to its end; a quoted value may hold the sign that ends a tag.
_REST = r"""(?:(?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*+>)"""
#: Tags that end a paragraph without </p>: blocks that cannot be in one, and the ends of what may hold one.
_BLOCK = (
    "address|article|aside|blockquote|body|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|"
    "main|menu|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
_PARAGRAPH = rf"(?is)<p(?=[\s/>]){_REST}(.*?)(?=</?(?:{_BLOCK})[\s/>]|\z)"


def _paragraphs():
    shown = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)(?=[\s/>]).*?</\1\s*>", "")
    found = F.regexp_extract_all(shown, F.lit(_PARAGRAPH), F.lit(1))
    broken = lambda x: F.regexp_replace(x, rf"(?i)<br(?=[\s/>]){_REST}", " ")
    return F.transform(found, lambda x: F.regexp_replace(broken(x), rf"</?[a-zA-Z]{_REST}", ""))


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, pos, text: paragraph elements, closed or not, without the tags inside them."""
    return pages.select("page_id", F.posexplode(_paragraphs()).alias("pos", "text"))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, pos, heading."""
    found = F.regexp_extract_all("html", F.lit(r"<h[1-6]>([^<]*)"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "heading"))


_HIDDEN = r"(?is)<!--.*?-->|<(script|style)(?=[\s/>]).*?</\1\s*>"
_HEAD = rf"(?is)^<h([1-6])(?=[\s/>]){_REST}(.*?)(?=</h[1-6]|\z)"


def outline(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, heading, html: pages cut before each heading; pos 0 is what stands before the first, of level 0."""
    parts = F.split(F.regexp_replace("html", _HIDDEN, ""), r"(?i)(?=<h[1-6][\s/>])")
    rows = pages.select("page_id", F.posexplode(F.concat(F.array(F.lit("")), parts)).alias("_k", "html"))
    # a page that begins with a heading has nothing before it
    begins = F.regexp_extract("html", _HEAD, 1)
    level = F.when(begins != "", begins.cast("int")).otherwise(0)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", _HEAD, 2), rf"</?[a-zA-Z]{_REST}", ""), r"\s+", " "))
    return rows.where("html != ''").select("page_id", F.col("_k").alias("pos"), level.alias("level"), plain.alias("heading"), "html")


def every_third(df: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The sampling scan: rows whose number is divisible by k."""
    return df.where(F.pmod(F.col(key), F.lit(k)) == 0)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query, id, rel of space-separated relevance files."""
    part = F.split("value", " +")
    return spark.read.text(path).select(
        F.get(part, F.lit(0)).alias("query"), F.get(part, F.lit(2)).alias("id"), F.get(part, F.lit(3)).cast("int").alias("rel")
    )


def read_run(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", " +")
    return spark.read.text(path).select(
        F.get(part, F.lit(0)).alias("query"),
        F.get(part, F.lit(2)).alias("id"),
        F.get(part, F.lit(3)).cast("int").alias("rank"),
        F.get(part, F.lit(4)).cast("double").alias("score"),
        F.get(part, F.lit(5)).alias("tag"),
    )


def read_ranklib(spark: SparkSession, path: str) -> DataFrame:
    """rel, qid, features, info of learning-to-rank rows."""
    body = F.split("value", "#", 2)
    part = F.split(F.trim(F.get(body, F.lit(0))), " +")
    pairs = F.slice(part, 3, F.size(part))
    return spark.read.text(path).select(
        F.get(part, F.lit(0)).cast("int").alias("rel"),
        F.replace(F.get(part, F.lit(1)), F.lit("qid:"), F.lit("")).cast("int").alias("qid"),
        F.transform(pairs, lambda p: F.get(F.split(p, ":"), F.lit(1)).cast("double")).alias("features"),
        F.trim(F.get(body, F.lit(1))).alias("info"),
    )


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """source, target, n of click streams; columns 0, 1 and 3."""
    raw = spark.read.csv(path, sep="\t", schema="c0 string, c1 string, c2 string, c3 long")
    return raw.select(F.col("c0").alias("source"), F.col("c1").alias("target"), F.col("c3").alias("n"))


def read_entity_map(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema="id string, entity string")
    return raw.select("id", F.replace("entity", F.lit(" "), F.lit("_")).alias("entity"))


def read_shared_features(spark: SparkSession, path: str) -> DataFrame:
    """query and the score arrays of paragraphs, entities and sections."""
    raw = spark.read.csv(path, sep="\t", schema="query string, p string, e string, s string")
    scores = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: x.cast("double"))
    return raw.select("query", scores("p").alias("paragraph"), scores("e").alias("entity"), scores("s").alias("section"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """topic, text of a folder of topic folders of text files."""
    raw = spark.read.text(f"{path}/*/*", wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("text"))
    return raw.select(F.regexp_extract("f", r"([^/]+)/[^/]+$", 1).alias("topic"), "text")


def read_weights(spark: SparkSession, path: str) -> list[float]:
    """The weights of a model file: the numbered pairs of its last line that has any, in their order."""
    whole = spark.read.text(path, wholetext=True).orderBy(F.input_file_name())
    pair = r"(?m)^\s*\d+:\S+(?: +\d+:\S+)*\s*$"
    last = F.element_at(F.regexp_extract_all("value", F.lit(pair), F.lit(0)), -1)
    found = whole.where(F.regexp_count("value", F.lit(pair)) > 0).select(F.transform(F.regexp_extract_all(last, F.lit(r":(\S+)")), lambda x: x.cast("double")).alias("w"))
    rows = found.collect()  # a row a file
    return list(rows[-1]["w"]) if rows else []


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(fold, train, test, mean) of a training log: lines of MAP come in pairs, a pair a fold, from 1."""
    values = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^MAP on[^:\n]*:\s*([-0-9.eE]+)")), lambda x: x.cast("double"))
    rows = spark.read.text(path, wholetext=True).select(values.alias("v"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("v") / 2).cast("int")), lambda k: F.struct(k.alias("fold"), F.get("v", 2 * k - 2).alias("train"), F.get("v", 2 * k - 1).alias("test")))
    return rows.where(F.size("v") > 1).select(F.explode(pairs).alias("p")).select("p.*", ((F.col("p.train") + F.col("p.test")) / 2).alias("mean"))
