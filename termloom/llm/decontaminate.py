"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words and cut into windows; all windows of all items
form one automaton over word numbers, which reads every document once. A word is
one step, so a window of ten words has at most ten nodes, whatever its length in
bytes. Matches come back as word intervals and, for documents that have any, as
character offsets of the original.

An automaton's size is bounded by SHARD_NODES nodes, counted before any is built;
items that need more are dealt to several automata, and no worker holds two.

Defined cases: null or empty text has no words and no hit; items without words
match nothing; an item shorter than a window is one window; repeated items count
under each of their ids, null ids not; repeated documents are answered row by row;
an empty table gives an empty result; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.words import column_of, held, slices
from termloom.session import ship, written

_MAP = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Nodes of one automaton, some 50 bytes each; a word of an item makes at most as many as a window has words.
SHARD_NODES = 4_000_000
#: Bytes of the item texts of one automaton, which is what a broadcast holds.
SHARD_BYTES = 16 << 20
#: Words of an item that are dealt together, with the words its last windows reach over.
CHUNK = 4_096

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(_SPAN)),
    ]
)


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text: ASCII letters lowered, runs of letters, digits and non-ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_MAP).split()


def item_windows(items, window: int) -> dict[tuple[bytes, ...], set[int]]:
    """For each window of the items (id, text), as words, the ids that have it; null ids have none."""
    found: dict[tuple[bytes, ...], set[int]] = {}
    for item_id, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - window + 1)) if words else ():
            ids = found.setdefault(tuple(words[i : i + window]), set())
            if item_id is not None:
                ids.add(item_id)
    return found


class _Numbers(dict):
    """Words to characters; a word of no item is the character that no window has."""

    def __missing__(self, word: bytes) -> str:
        return "\x00"


class Matcher:
    """The automaton of all windows of some items."""

    def __init__(self, items, window: int):
        import ahocorasick

        self.made, self.numbers = ahocorasick.Automaton(), _Numbers()
        for words, ids in item_windows(items, window).items():
            for w in words:
                if w not in self.numbers:
                    n = len(self.numbers) + 1
                    self.numbers[w] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
            self.made.add_word("".join(map(self.numbers.__getitem__, words)), (len(words), tuple(ids)))
        if len(self.made):
            self.made.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit word intervals (disjoint, in order), ids of items found."""
        words = normal_words(text)
        if not words or not len(self.made):
            return len(words), [], set()
        intervals, ids = [], set()
        for end, (n, items) in self.made.iter("".join(map(self.numbers.__getitem__, words))):
            intervals.append((end + 1 - n, end + 1))
            ids.update(items)
        return len(words), covered(intervals), ids


def covered(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word intervals, as disjoint ones in order."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: str, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets, in the text as it was, of word intervals."""
    at = [m.span() for m in _ORIGINAL.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in intervals]


def _matcher(name: str, shared, window: int) -> Matcher:
    """The automaton of a broadcast, by a name that no other one has."""
    return held(name, lambda: Matcher(shared.value, window))


def _answer(batch: pa.RecordBatch, rows, keep: list[str]) -> pa.RecordBatch:
    """The columns of HITS for rows (n_words, intervals, ids), beside the kept ones."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(HITS)
    texts = column_of(batch)
    spans = [
        [{"start": a, "end": b} for a, b in original_spans(texts[k].as_py(), iv)] if iv else [] for k, (_, iv, _) in enumerate(rows)
    ]
    values = (
        [n for n, _, _ in rows],
        [sum(b - a for a, b in iv) for _, iv, _ in rows],
        [sorted(ids) for _, _, ids in rows],
        spans,
    )
    columns = [pa.array(v, schema.field(k).type) for k, v in enumerate(values)]
    return pa.RecordBatch.from_arrays([*map(batch.column, keep), *columns], names=[*keep, *schema.names])


def _scanner(name: str, shared, window: int, keep: list[str]):
    """Answers rows by one automaton that holds all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _matcher(name, shared, window)
        for whole in batches:
            for batch in slices(whole):
                yield _answer(batch, [made.scan(t) for t in column_of(batch).to_pylist()], keep)

    return run


def _hits_of(name: str, shared, window: int):
    """The digest, intervals and item ids of texts that one of several automata hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _matcher(name, shared, window)
        for whole in batches:
            for batch in slices(whole):
                digest, flat, found = [], [], []
                for d, t in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    _, intervals, ids = made.scan(t)
                    if intervals:
                        digest.append(d)
                        flat.append([x for p in intervals for x in p])
                        found.append(sorted(ids))
                many = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.string()), pa.array(flat, many), pa.array(found, many)], names=["digest", "flat", "ids"]
                )

    return run


def _joiner(keep: list[str]):
    """Answers rows that carry the hits of several automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text, flats, ids in zip(
                    column_of(batch).to_pylist(), batch.column("flats").to_pylist(), batch.column("ids").to_pylist(), strict=True
                ):
                    intervals = [p for f in flats or () for p in zip(f[::2], f[1::2], strict=True)]
                    rows.append((len(normal_words(text)), covered(intervals), {x for many in ids or () for x in many}))
                yield _answer(batch, rows, keep)

    return run


def _chunks(window: int):
    """Items cut to overlapping chunks of words, so one long item is dealt like many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = [w.decode("utf-8", "surrogatepass") for w in normal_words(text)]
                for a in range(0, max(1, len(words) - window + 1), CHUNK) if words else ():
                    part = words[a : a + CHUNK + window - 1]
                    rows.append((item, a, " ".join(part), len(part)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item_id", "first", "text", "n"]
            )

    return run


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    shard_nodes: int = SHARD_NODES,
    shard_bytes: int = SHARD_BYTES,
    carry: bool = False,
) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, item_ids (sorted), spans (original offsets).

    With carry, all columns of the document come as the struct own in place of doc_id.

    docs has doc_id and text, items has item_id and text. The nodes and bytes that
    the items can need are counted first. Where they fit in one automaton, documents
    pass it once. Otherwise each automaton reports the texts it hits, by their
    digest, and these reports are joined to the documents; an automaton's items
    alone come to the driver at a time.
    """
    spark = ship(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = written(items.mapInArrow(_chunks(window), "item_id long, first long, text string, n long"), "items")
    told = parts.agg(F.sum("n").alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # a node a word at least, and fewer distinct words than there are characters
    shards = 1 + max((told["words"] or 0) * max(window, 4) // shard_nodes, (told["bytes"] or 0) // shard_bytes)
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("item_id", "first", "text"), F.lit(shards)))

    def automaton(k: int):
        part = dealt.where(F.col("shard") == k).select("item_id", "text")
        return uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in part.collect()]), window

    text = docs.withColumn("text", F.col("text").cast("string"))
    if carry:
        rows, keep = text.select(F.struct(*docs.columns).alias("own")), ["own"]
    else:
        rows, keep = text.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]
    schema = T.StructType([*(rows.schema[c] for c in keep), *HITS])
    if shards == 1:
        return rows.mapInArrow(_scanner(*automaton(0), keep), schema)
    whole = F.col("own")["text"] if carry else F.col("text")
    digest = F.sha2(F.coalesce(whole, F.lit("")), 256)
    asked = rows.select(digest.alias("digest"), whole.alias("text"))
    hits = None
    for k in range(shards):
        # equal texts have equal hits in an automaton
        found = asked.mapInArrow(_hits_of(*automaton(k)), "digest string, flat array<long>, ids array<long>").dropDuplicates(["digest"])
        found = written(found, "hits")
        hits = found if hits is None else hits.unionByName(found)
    told = hits.groupBy("digest").agg(F.collect_list("flat").alias("flats"), F.collect_list("ids").alias("ids"))
    joined = rows.withColumn("digest", digest).join(told, "digest", "left")
    return joined.select(*rows.columns, "flats", "ids").mapInArrow(_joiner(keep), schema)


def op8_aho_corasick_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words in benchmark windows, items found and their digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = find_contamination(docs, items, window=10)
    joined = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs, items, window: int = 10):
    """The contract's columns by comparing every window of words; for tests."""
    wins = [(i, [w[k : k + window] for k in range(max(1, len(w) - window + 1))]) for i, t in items if (w := normal_words(t))]
    for doc_id, text in docs:
        words, hit, found = normal_words(text), set(), set()
        for item, parts in wins:
            for part in parts:
                for s in range(len(words) - len(part) + 1):
                    if words[s : s + len(part)] == part:
                        hit.update(range(s, s + len(part)))
                        found.add(item)
        digest = hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest()
        yield doc_id, len(words), len(hit), len({x for x in found if x is not None}), digest, bool(hit)
