"""An index on disk that any session opens by its path: immutable runs and a manifest.

A run is a folder of postings, terms and lengths. The manifest with the highest number
names the runs that count; changing the index is writing new folders and then the next
manifest, which one writer alone can create, so readers see all of a change or nothing.
Opening reads the manifest, no catalog. Postings lie in ranges of (field, term, key):
searches read the row groups of their terms, and a term that a third of all documents
has fills many files, not one.

A document that is added again replaces what the index has of it. An index of no
document is empty tables; what no manifest names any more stays until vacuum().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs from which on an index is merged into one.
FANOUT = 8


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    where, files = _files(spark, path)
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest: version, key, its type, and runs; none where there is no index."""
    known = _versions(spark, path)
    if not known:
        return None
    return json.loads(spark.read.text(f"{path}/manifest-{known[-1]:09d}.json", wholetext=True).first()[0])


def commit(spark: SparkSession, path: str, told: dict) -> None:
    """The next manifest, written aside and renamed; raises if another writer was first."""
    where, files = _files(spark, f"{path}/manifest-{told['version']:09d}.json")
    aside, _ = _files(spark, f"{path}/.manifest-{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    if files.exists(where) or not files.rename(aside, where):
        files.delete(aside, False)
        raise RuntimeError(f"{path} was changed by another writer")


def _write(p: DataFrame, path: str, key: str) -> str:
    """A run of postings (field, key, term, tf) under path."""
    spark, name = p.sparkSession, f"run-{uuid.uuid4().hex}"
    rows = p.select("field", key, "term", "tf").withColumn("dl", F.sum("tf").over(Window.partitionBy("field", key)))
    order = ["field", "term", key]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("field").parquet(f"{path}/{name}/postings")
    back = _postings(spark, path, name, dict(p.dtypes)[key], key)
    back.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf")).write.parquet(f"{path}/{name}/terms")
    back.groupBy("field", key).agg(F.max("dl").alias("dl"), F.count("*").alias("distinct_terms")).write.parquet(f"{path}/{name}/lengths")
    return name


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _postings(spark: SparkSession, path: str, run: str, kind: str, key: str) -> DataFrame:
    return _read(spark, f"{path}/{run}/postings", f"`{key}` {kind}, term string, tf long, dl long, field string").select("field", key, "term", "tf", "dl")


def open_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """postings, terms and lengths of the index at path, in any session."""
    told = manifest(spark, path)
    if told is None:
        raise FileNotFoundError(f"no index at {path}")
    key, kind, runs = told["key"], told["kind"], told["runs"]
    if not runs:
        empty = lambda s: spark.createDataFrame([], T._parse_datatype_string(s))
        return {
            "postings": empty(f"field string, `{key}` {kind}, term string, tf long, dl long"),
            "terms": empty("field string, term string, df long, ttf long"),
            "lengths": empty(f"field string, `{key}` {kind}, dl long, distinct_terms long"),
        }

    def union(make) -> DataFrame:
        out = make(runs[0])
        for r in runs[1:]:
            out = out.unionByName(make(r))
        return out

    terms = union(lambda r: _read(spark, f"{path}/{r}/terms", "field string, term string, df long, ttf long"))
    if len(runs) > 1:
        terms = terms.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))
    return {
        "postings": union(lambda r: _postings(spark, path, r, kind, key)),
        "terms": terms,
        "lengths": union(lambda r: _read(spark, f"{path}/{r}/lengths", f"field string, `{key}` {kind}, dl long, distinct_terms long")),
    }


def create(p: DataFrame, path: str, key: str = "doc_id") -> dict[str, DataFrame]:
    """Writes postings (field, key, term, tf) as a new index, in place of one that is there, and opens it."""
    spark = p.sparkSession
    known = _versions(spark, path)
    told = {"version": (known[-1] if known else 0) + 1, "key": key, "kind": dict(p.dtypes)[key], "runs": [_write(p, path, key)]}
    commit(spark, path, told)
    return open_index(spark, path)


def append(p: DataFrame, path: str) -> dict[str, DataFrame]:
    """Adds the postings of documents; those that the index had before are replaced, by merging all runs at once."""
    spark = p.sparkSession
    told = manifest(spark, path)
    if told is None:
        return create(p, path)
    key = told["key"]
    old = open_index(spark, path)
    fresh = _write(p, path, key)
    again = _read(spark, f"{path}/{fresh}/lengths", f"`{key}` {told['kind']}").distinct()
    runs = [*told["runs"], fresh]
    replaced = not old["lengths"].select(key).distinct().join(again, key, "left_semi").isEmpty()
    if replaced or len(runs) > FANOUT:
        kept = old["postings"].join(again, key, "left_anti") if replaced else old["postings"]
        runs = [_write(kept.unionByName(_postings(spark, path, fresh, told["kind"], key)), path, key)]
    commit(spark, path, told | {"version": told["version"] + 1, "runs": runs})
    return open_index(spark, path)


def compact(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One run in place of all."""
    told = manifest(spark, path)
    if told and len(told["runs"]) > 1:
        run = _write(open_index(spark, path)["postings"], path, told["key"])
        commit(spark, path, told | {"version": told["version"] + 1, "runs": [run]})
    return open_index(spark, path)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes the runs and manifests that the newest manifest doesn't name; for when no reader has an older one open."""
    told = manifest(spark, path)
    if told is None:
        return []
    where, files = _files(spark, path)
    stay = {*told["runs"], f"manifest-{told['version']:09d}.json"}
    gone = [f.getPath() for f in files.listStatus(where) if f.getPath().getName() not in stay and f.getPath().getName().startswith(("run-", "manifest-"))]
    for p in gone:
        files.delete(p, True)
    return sorted(p.getName() for p in gone)
