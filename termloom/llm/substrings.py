"""Exact substring deduplication on a log-structured fingerprint index.

A window is so many consecutive words. Each document's windows are fingerprinted
once: the smallest word-gram hash in a window is its anchor, so equal windows have
equal anchors at equal places, and neighbouring windows share theirs; about one
word in fourteen starts an anchor. The index keeps, for each anchor hash, how
often it occurs and the smallest and largest hash of the words around it, in
immutable runs sorted by anchor hash. A new batch becomes a run of its own; runs
are merged by anchor hash when they are read, and compacted to one now and then.

An anchor met twice leads to candidates, which are verified by a second hash of the
words themselves: where all occurrences agree on every word of their windows, the
windows are repeated; where they differ, one occurrence of each kind is read again
and its windows are compared one by one under 128 bits. So a passage with thousands
of copies costs one row a copy, and no pairs are made.

Defined cases: null or empty text has no words; a repeated row repeats its windows;
rows of equal doc_id are judged apart unless their text is equal too; a null doc_id
is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.words import (
    BASE,
    BASE2,
    Spans,
    mixed,
    position_in_text,
    signed,
    slices,
    split_words,
)
from termloom.operators import diskindex
from termloom.session import scratch_path, ship, written

WINDOW = 35
GRAM = 8
#: Keys that a broadcast may hold, 8 bytes each; more take a shuffle.
BROADCAST_KEYS = 500_000
#: A value is heavy if it has more than this part of all rows; so there are fewer such values than this number.
HEAVY = 2_000

PRINTS = (
    "doc_id long, key long, n_words long, sha256 string, "
    "anchor array<long>, content array<long>, start array<int>, n array<int>"
)
TEXTS = "doc_id long, text string"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.withColumn("key", F.xxhash64("doc_id", "text"))


def _left_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For each start of width values, the place of the smallest, the leftmost of equals."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        have += step
    return at


def anchors(h: np.ndarray, starts: np.ndarray, window: int, gram: int):
    """Runs of windows with one anchor, over the word hashes of several texts.

    Returns text, first window's start within it, number of windows, anchor hash
    and hash of all the words that these windows have.
    """
    counts = np.diff(starts)
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        g = g * np.uint64(BASE) + h[k : len(h) - gram + 1 + k]
    g = mixed(g)
    at = _left_minimum(g, window - gram + 1)
    within = position_in_text(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero((within + window <= counts[text])[: len(at)])
    if not len(whole):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = at[whole]
    edge = np.flatnonzero((np.diff(at) != 0) | (np.diff(text[whole]) != 0)) + 1
    first = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([first, [len(whole)]]))
    begin = whole[first]
    spans = Spans(h, BASE2).of(begin, begin + size - 1 + window)
    shape = (at[first] - begin).astype(np.uint64) * np.uint64(1 << 32) + size.astype(np.uint64)
    return text[begin], within[begin], size, g[at[first]], mixed(spans ^ mixed(shape))


def _printer(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                w = split_words(batch.column("text"))
                text, start, size, anchor, content = anchors(w.hashes(), w.starts, window, gram)
                offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
                shas = [
                    hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).hexdigest()
                    for t in batch.column("text").to_pylist()
                ]
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(x))
                    for x in (signed(anchor), signed(content), start.astype(np.int32), size.astype(np.int32))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), pa.array(w.counts), pa.array(shas), *lists],
                    names=["doc_id", "key", "n_words", "sha256", "anchor", "content", "start", "n"],
                )

    return run


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row a document: its key, words, the digest of its words, and its anchors as arrays."""
    ship(docs.sparkSession)
    return keyed(docs).mapInArrow(_printer(window, gram), PRINTS)


class FingerprintIndex:
    """Immutable runs of (anchor, total, low, high), each bucketed and sorted by anchor.

    total counts occurrences, low and high are the least and greatest content hash
    seen with the anchor. Runs only ever get added or replaced by their merger. A
    batch meets every run by a merge join on the buckets, so runs are not shuffled.

    With a path the index lasts: a manifest there names its runs, and the fingerprints
    and texts of every batch that it has judged, so another session that opens the path
    goes on where this one ended. A batch counts once its manifest is there; runs that
    no manifest names any more go by diskindex.vacuum. Nothing stays in a catalog.
    """

    SCHEMA = "anchor long, total long, low long, high long"

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.path, self.fanout, self.lasts = spark, path or scratch_path(spark, "index"), fanout, path is not None
        told = (diskindex.manifest(spark, path) if path else None) or {"version": 0, "runs": [], "buckets": {}, "history": []}
        self.version, self.runs, self.buckets = told["version"], list(told["runs"]), dict(told["buckets"])
        self._kept: list[list[str]] = [list(x) for x in told["history"]]
        #: (docs, prints) of what was judged before: later batches are verified against its contents and texts.
        self.history: list[tuple[DataFrame, DataFrame]] = [
            (spark.read.schema(TEXTS).parquet(f"{path}/{t}"), spark.read.schema(PRINTS).parquet(f"{path}/{p}")) for t, p in self._kept
        ]

    def _store(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        table = f"termloom_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = rows.repartition(buckets, "anchor").write.bucketBy(buckets, "anchor").sortBy("anchor")
        writer.option("path", f"{self.path}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # its files stay, as they lie at a path of their own
        self.buckets[name] = buckets
        return name

    def _run(self, name: str) -> DataFrame:
        """A run with its buckets: a table names them while the plan is made, and goes then."""
        table = f"termloom_{uuid.uuid4().hex}"
        at = f"{self.path}/{name}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {table} (anchor BIGINT, total BIGINT, low BIGINT, high BIGINT) USING parquet "
            f"CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets[name]} BUCKETS LOCATION '{at}'"
        )
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE {table}")

    def stored(self, rows: DataFrame, name: str) -> tuple[DataFrame, str]:
        """Rows in the index's folder if it lasts, else in scratch; and the folder's name."""
        name = f"{name}-{uuid.uuid4().hex}"
        return written(rows, name, f"{self.path}/{name}" if self.lasts else None), name

    def judged(self, docs: DataFrame, prints: DataFrame, prints_name: str) -> None:
        """A batch counts as history from now on, for this and, if the index lasts, for later sessions."""
        if self.lasts:
            docs, texts_name = self.stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "texts")
            self._kept.append([texts_name, prints_name])
            self.version += 1
            told = {"version": self.version, "runs": self.runs, "buckets": {r: self.buckets[r] for r in self.runs}, "history": self._kept}
            diskindex.commit(self.spark, self.path, told)
        self.history.append((docs, prints))

    @staticmethod
    def summed(prints: DataFrame) -> DataFrame:
        """The run of a batch; occurrences are summed before they are shuffled."""
        rows = prints.select(F.inline(F.arrays_zip("anchor", "content")))
        return rows.groupBy("anchor").agg(F.count("*").alias("total"), F.min("content").alias("low"), F.max("content").alias("high"))

    def add(self, prints: DataFrame) -> None:
        """A batch of fingerprints becomes a run."""
        self.runs.append(self._store(self.summed(prints)))
        if len(self.runs) > self.fanout:
            self.compact()

    def merged(self) -> DataFrame:
        """All runs as one, merged by anchor; the buckets are those of the runs."""
        if not self.runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        out = self._run(self.runs[0])
        for name in self.runs[1:]:
            other = self._run(name).toDF("anchor", "t", "l", "h")
            out = out.join(other.hint("merge"), "anchor", "full").select(
                "anchor",
                (F.coalesce("total", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("total"),
                F.least("low", "l").alias("low"),
                F.greatest("high", "h").alias("high"),
            )
        return out

    def compact(self) -> None:
        """One run in place of all; the old ones stay until no reader can need them."""
        if len(self.runs) > 1:
            self.runs = [self._store(self.merged())]


def with_counts(rows: DataFrame, counts: DataFrame, on: list[str], total: str = "total") -> DataFrame:
    """rows joined with counts by on, whatever part of the rows one value has.

    Values that have more than 1 / HEAVY of all rows are fewer than HEAVY, so their
    counts are broadcast and their rows stay where they are; the others are shuffled.
    """
    most = counts.agg(F.sum(total).alias("n")).first()["n"] or 0
    heavy = F.broadcast(counts.where(F.col(total) * HEAVY > most))
    # one plan at every size
    light = rows.join(heavy.select(*on), on, "left_anti").join(counts.where(F.col(total) * HEAVY <= most).hint("merge"), on)
    return rows.join(heavy, on).unionByName(light)


def _window_rows(window: int):
    """Windows (two hashes) of the listed runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                w = split_words(batch.column("text"))
                h = w.hashes()
                a, b = Spans(h, BASE), Spans(h, BASE2)
                at, key, place, alone = [], [], [], []
                for t, (k, runs) in enumerate(
                    zip(batch.column("key").to_pylist(), batch.column("runs").to_pylist(), strict=True)
                ):
                    for r in runs:
                        s = np.arange(r["start"], r["start"] + r["n"])
                        place.append(s)
                        at.append(s + w.starts[t])
                        key.append(np.full(len(s), k))
                        alone.append(np.full(len(s), r["alone"]))
                if not at:
                    continue
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(a.of(at, at + window))),
                        pa.array(signed(b.of(at, at + window))),
                        pa.array(np.concatenate(key)),
                        pa.array(np.concatenate(place).astype(np.int32)),
                        pa.array(np.concatenate(alone)),
                    ],
                    names=["w1", "w2", "key", "start", "alone"],
                )

    return run


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents that have one of the keys; a counted, bounded set of keys is broadcast, any other is shuffled."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def repeated_runs(docs: DataFrame, prints: DataFrame, index: FingerprintIndex, window: int = WINDOW) -> DataFrame:
    """(key, start, n): n consecutive windows from start that each occur elsewhere too.

    prints are fingerprints that the index holds, docs their texts; what it held
    before is in its history, and counts as elsewhere.
    """
    found = index.merged().where("total > 1")
    occurrences = prints.select("key", F.inline(F.arrays_zip("anchor", "content", "start", "n")))
    hits = with_counts(occurrences, found, ["anchor"]).select(
        "anchor", "content", "key", "start", "n", (F.col("low") == F.col("high")).alias("alike")
    )
    hits = written(hits, "hits")
    sure = hits.where("alike").select("key", "start", "n")
    mixed_ones = hits.where("not alike").drop("alike").withColumn("fresh", F.lit(True))
    if index.history:
        asked = mixed_ones.select("anchor").distinct()
        for _, old in index.history:
            rows = old.select("key", F.inline(F.arrays_zip("anchor", "content", "start", "n"))).join(asked, "anchor", "left_semi")
            mixed_ones = mixed_ones.unionByName(rows.withColumn("fresh", F.lit(False)))
        mixed_ones = written(mixed_ones, "mixed")
    kinds = mixed_ones.groupBy("anchor", "content").agg(
        F.count("*").alias("total"), F.min(F.xxhash64("key", "start")).alias("one")
    )
    kinds = written(kinds, "counts")
    known = written(with_counts(mixed_ones, kinds, ["anchor", "content"]), "kinds")
    several = known.where("total > 1 and fresh").select("key", "start", "n")
    read = (
        known.where(F.xxhash64("key", "start") == F.col("one"))
        .select("key", "start", "n", (F.col("total") == 1).alias("alone"))
        .distinct()
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "n", "alone")).alias("runs"))
    )
    texts = _only(keyed(docs), read.select("key")).select("key", "text")
    for old, _ in index.history:
        texts = texts.unionByName(_only(keyed(old), read.select("key")).select("key", "text"))
    texts = texts.dropDuplicates(["key"])
    rows = written(
        texts.join(read, "key").mapInArrow(
            _window_rows(window), "w1 long, w2 long, key long, start int, alone boolean"
        ),
        "windows",
    )
    twice = rows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    alone = rows.where("alone").join(twice, ["w1", "w2"]).select("key", "start", F.lit(1).alias("n"))
    return sure.unionByName(several).unionByName(alone)


def covered_words(runs, window: int):
    """Column: words under the union of runs, an array of (start, n)."""
    end = lambda r: r["start"] + r["n"] - 1 + window
    return F.aggregate(
        F.sort_array(runs),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0), end(r) - F.greatest(r["start"], s["end"]))).cast("long").alias("n"),
            F.greatest(s["end"], end(r)).alias("end"),
        ),
        lambda s: s["n"],
    )


def keep(text: str | None, runs: list[tuple[int, int]], window: int) -> bytes:
    """The words outside all runs, joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    kept, at = [], 0
    for start, n in sorted(runs):
        kept += words[at:start]
        at = max(at, start + n - 1 + window)
    return b" ".join(kept + words[at:])


def _keeper(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                kept = [
                    keep(t, [(r["start"], r["n"]) for r in runs], window)
                    for t, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("doc_id", "n_words", "n_removed")),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                        pa.array([k.decode("utf-8", "surrogatepass") for k in kept]),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def dedup_substrings(
    docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, batches: int = 2, index: FingerprintIndex | None = None
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.

    With an index that was used before, here or, if it has a path, in another session,
    windows that earlier calls met count too; docs of those calls are read again where a
    window has to be compared.

    Texts are read again only where a part of them goes: the digests of untouched
    texts are known from the first reading, and that of nothing is a constant.
    """
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark)
    prints, prints_name = index.stored(fingerprints(docs, window, gram), "prints")
    for k in range(batches):
        index.add(prints.where(F.pmod("key", F.lit(batches)) == k))
    index.compact()
    runs = repeated_runs(docs, prints, index, window)
    index.judged(docs, prints, prints_name)
    by_text = runs.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    judged = written(
        prints.select("doc_id", "key", "n_words", "sha256")
        .join(by_text, "key", "left")
        .withColumn("n_removed", F.coalesce(covered_words(F.col("runs"), window), F.lit(0)).cast("long")),
        "judged",
    )
    partly = (F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_words"))
    nothing = hashlib.sha256(b"").hexdigest()
    easy = judged.where(~partly).select(
        "doc_id", "n_words", "n_removed", F.when(F.col("n_removed") > 0, nothing).otherwise(F.col("sha256")).alias("kept_sha256")
    )
    some = judged.where(partly).select("key", "n_words", "n_removed", "runs").dropDuplicates(["key"])
    rest = (
        _only(keyed(docs), some.select("key"))
        .join(some, "key")
        .mapInArrow(_keeper(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
        .drop("kept_text")
    )
    return easy.unionByName(rest)


def op7_fingerprint_index_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of all documents outside windows of 35 words that occur more than once."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=35)


def brute_force(docs, window: int = WINDOW):
    """The contract's columns by counting every window; for tests."""
    from collections import Counter

    split = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    for d, w in split:
        gone = {
            p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)
        }
        left = b" ".join(x for p, x in enumerate(w) if p not in gone)
        yield d, len(w), len(gone), hashlib.sha256(left).hexdigest()
