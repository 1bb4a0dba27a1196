"""Toxicity by a counterfactual-regularised classifier.

A text is scored by a logistic model over the rates of its words' features: a
word, its prefixes, all hashed. Rates make the score independent of length, so a
long clean text does not collect chance matches. Training takes a bounded sample
of labelled texts, whole; each sentence there that mentions an identity term is
also written with another term of the same kind and language, and the squared
change of the score is added to the loss, so the mention alone cannot carry weight.

Features are chosen by how far their document frequencies in the two classes are
apart, in standard errors; the rest have weight 0.

Defined cases: null or empty texts get the score of a text without any feature;
without labelled rows of both classes every score is the share of label 1 (0.5
without any); null labels are ignored; repeated rows are scored row by row; a null
doc_id is not held out and never trains; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import bytes_hash, mixed, slices, split_words
from termloom.session import ship, written

#: Labelled texts that a model is fitted on, at most about twice as many are read.
SAMPLE = 4_000
#: Where a sentence ends.
_SENTENCE = re.compile(r"[.!?]+\s|\n").split
BITS = 20
PREFIXES = (4, 5, 6, 7)
SMOOTH = 20.0
THRESHOLD = 0.7

#: Identity terms by kind; a swap stays within a kind and language.
IDENTITY = {
    "religion": {
        "en": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
        "de": ("christlich", "muslimisch", "jüdisch", "hinduistisch", "atheistisch"),
        "fr": ("chrétien", "musulman", "juif", "hindou", "athée"),
        "es": ("cristiano", "musulmán", "judío", "hindú", "ateo"),
    },
    "gender": {
        "en": ("women", "men", "transgender", "nonbinary"),
        "de": ("frauen", "männer", "transgender", "nichtbinär"),
        "fr": ("femmes", "hommes", "transgenre", "nonbinaire"),
        "es": ("mujeres", "hombres", "transgénero", "nobinario"),
    },
    "orientation": {
        "en": ("gay", "lesbian", "straight", "bisexual", "queer"),
        "de": ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
        "fr": ("homosexuel", "lesbienne", "hétérosexuel", "bisexuel"),
        "es": ("homosexual", "lesbiana", "heterosexual", "bisexual"),
    },
    "origin": {
        "en": ("african", "asian", "european", "american", "arab", "latino", "immigrant"),
        "de": ("afrikanisch", "asiatisch", "europäisch", "arabisch", "einwanderer"),
        "fr": ("africain", "asiatique", "européen", "arabe", "immigré"),
        "es": ("africano", "asiático", "europeo", "árabe", "inmigrante"),
    },
}
#: Frequent words that tell which language's terms a sentence has.
_FREQUENT = {
    "en": frozenset("the and of to a in is that it for are with they this was not have".split()),
    "de": frozenset("der die und das ist nicht ein eine sind mit den von zu sie auf dem".split()),
    "fr": frozenset("le la les et des est une un dans que qui ne pas sont du pour".split()),
    "es": frozenset("el los las y que es una en de no por con son se del para".split()),
}
#: For each language, the terms that a term may be swapped with.
_SWAPS = {
    lang: {t: [x for x in kinds[lang] if x != t] for kinds in IDENTITY.values() for t in kinds[lang]} for lang in _FREQUENT
}


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of each word, a row a word, and whether it has letters. Prefixes count characters."""
    clean = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", "")
    length = pc.utf8_length(clean).to_numpy(zero_copy_only=False)
    columns = [mixed(bytes_hash(clean) + np.uint64(1))]
    for p in PREFIXES:
        h = mixed(bytes_hash(pc.utf8_slice_codeunits(clean, 0, p)) + np.uint64(p << 32))
        columns.append(np.where(length >= p, h, columns[0]))
    ids = np.stack(columns, axis=1) & np.uint64((1 << BITS) - 1)
    return ids.astype(np.int64), length > 0


def text_rates(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its features' ids and rates."""
    w = split_words(texts)
    out = []
    ids, letters = word_features(w.words) if len(w.words) else (np.zeros((0, 1), np.int64), np.zeros(0, bool))
    for a, b in zip(w.starts[:-1], w.starts[1:], strict=True):
        codes = w.codes[a:b]
        codes = codes[letters[codes]]
        # a word shorter than a prefix has itself there once more: count each word's feature once
        f = ids[codes]
        fresh = np.ones(f.shape, bool)
        fresh[:, 1:] = f[:, 1:] != f[:, :1]
        used, count = np.unique(f[fresh], return_counts=True)
        out.append((used, (count / (len(codes) + SMOOTH)).astype(np.float32)))
    return out


def swapped(sentence: str, pick: int) -> str | None:
    """The sentence with its identity terms exchanged for others of their kind and language, None if it has none.

    Its language is the one with most frequent words and terms in it, the first of equals.
    """
    words = sentence.split()
    bare = [w.strip(".,;:!?\"'()").lower() for w in words]
    told = {lang: sum(b in terms for b in bare) for lang, terms in _SWAPS.items()}
    if not any(told.values()):
        return None
    lang = max((x for x in told if told[x]), key=lambda x: told[x] + sum(b in _FREQUENT[x] for b in bare))
    terms = _SWAPS[lang]
    return " ".join(w.lower().replace(b, terms[b][(pick + i) % len(terms[b])]) if b in terms else w for i, (w, b) in enumerate(zip(words, bare)))


def counterfactuals(text: str, pick: int) -> list[tuple[str, str]]:
    """Each sentence that has an identity term, and its swapped form."""
    out = []
    for k, sentence in enumerate(_SENTENCE(text)):
        other = swapped(sentence, pick + k)
        if other is not None:
            out.append((sentence, other))
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each label have a feature, counted a slice of whole texts at a time."""
    for whole in batches:
        for batch in slices(whole, limit=1 << 20):
            y = batch.column("y").to_pylist()
            parts = [f for f, _ in text_rates(batch.column("text"))]
            both = np.concatenate([f * 2 + label for f, label in zip(parts, y, strict=True)])
            key, n = np.unique(both, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((key >> 1).astype(np.int32)), pa.array(np.where(key & 1, 0, n)), pa.array(np.where(key & 1, n, 0))],
                names=["f", "n0", "n1"],
            )


def _rows_of(chosen: np.ndarray):
    """Rates of the chosen features: a row a text, and one a sentence with an identity term and its swapped form."""
    at = np.full(1 << BITS, -1)
    at[chosen] = np.arange(len(chosen))

    def only(found):
        k = at[found[0]]
        return k[k >= 0].astype("<i4").tobytes(), found[1][k >= 0].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                hs = batch.column("h").to_pylist()
                rows = [
                    (y, h, *only(r), None, None) for y, h, r in zip(batch.column("y").to_pylist(), hs, text_rates(batch.column("text")), strict=True)
                ]
                pairs = [(h, *p) for t, h in zip(batch.column("text").to_pylist(), hs, strict=True) for p in counterfactuals(t or "", h & 0xFF)]
                one, two = (text_rates(pa.array([p[k] for p in pairs], pa.string())) for k in (1, 2))
                # the hash of a pair depends on its words, so the least ones are no one text's
                rows += [(None, hash_of(p), *only(a), *only(b)) for p, a, b in zip(pairs, one, two, strict=True)]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["y", "h", "f", "r", "f2", "r2"]
                )

    return run


def hash_of(pair: tuple) -> int:
    return zlib.crc32(repr(pair).encode("utf-8", "surrogatepass"))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        w = split_words(texts)
        n = len(w.starts) - 1
        total = np.zeros(n)
        if len(w.words):
            ids, letters = word_features(w.words)
            each = self.weights[ids]
            each[:, 1:][ids[:, 1:] == ids[:, :1]] = 0
            value = np.where(letters, each.sum(axis=1), 0.0)
            text = np.repeat(np.arange(n), w.counts)
            many = np.bincount(text, letters[w.codes], n)
            total = np.bincount(text, value[w.codes], n) / (many + SMOOTH)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def choose(found, n0: int, n1: int, *, apart: float = 4.0, most: int = 4_000) -> np.ndarray:
    """Features, of rows (feature, texts of label 0, of label 1), whose shares differ by so many standard errors."""
    if not len(found) or not n0 or not n1:
        return np.zeros(0, np.int64)
    f, a, b = (np.array(c, float) for c in zip(*found, strict=True))
    p = (a + b) / (n0 + n1)
    gap = np.abs(b / n1 - a / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    order = np.lexsort((f, -gap))[:most]
    return f[order[(gap[order] >= apart)]].astype(np.int64)


def fit(rows: list[tuple], pairs: list[tuple], chosen: np.ndarray, *, fairness: float = 10.0, ridge: float = 2e-4, steps: int = 400) -> Model:
    """A model of rows (label, places, rates) and pairs (places, rates, places, rates); places are in chosen."""
    y = np.array([r[0] for r in rows], float)
    weights = np.zeros(1 << BITS, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model(weights, float(np.log(share / (1 - share))))
    n1, n0 = y.sum(), len(y) - y.sum()
    if not len(chosen):
        return Model(weights, float(np.log(n1 / n0)))

    def matrix(parts):
        out = np.zeros((len(parts), len(chosen)), np.float32)
        for i, (k, r) in enumerate(parts):
            out[i, k] = r
        return out

    x = matrix([(r[1], r[2]) for r in rows])
    change = matrix([p[2:4] for p in pairs]) - matrix([p[:2] for p in pairs]) if pairs else x[:0]
    scale = np.maximum(np.sqrt((x**2).mean(axis=0)), 1e-4)
    x, change = x / scale, change / scale
    w, b = np.zeros(len(chosen)), float(np.log(n1 / n0))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        q = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        g = x.T @ (q - y) / len(y) + ridge * w
        if len(change):
            g += fairness * change.T @ (change @ w) / len(change)
        gb = float((q - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights[chosen] = w / scale
    return Model(weights, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, *, apart: float = 4.0, most: int = 4_000, **options) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), from a bounded sample of rows by hash.

    The sampled texts are read whole, twice: to count the features of each label,
    and for the rates of those that tell the labels apart.
    """
    ship(docs.sparkSession)
    told = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    )
    share = sample / max(1, told.count())
    picked = told.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).orderBy("h", "doc_id").limit(2 * sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # an id with many rows has its least texts, by hash, in the sample
    rows = texts.join(F.broadcast(picked), "doc_id").select("y", "h", "text")
    rows = written(rows.orderBy("h", F.xxhash64("text")).limit(4 * sample), "labelled")
    n = dict(rows.groupBy("y").count().collect())
    counted = rows.mapInArrow(_frequencies, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    chosen = choose(counted.where("n0 + n1 >= 3").collect(), n.get(0, 0), n.get(1, 0), apart=apart, most=most)
    seen = rows.mapInArrow(_rows_of(chosen), "y int, h long, f binary, r binary, f2 binary, r2 binary")
    number = lambda raw, kind: np.frombuffer(raw, kind)
    found = [(r["y"], number(r["f"], "<i4"), number(r["r"], "<f4")) for r in seen.where("y is not null").orderBy("h", "f", "r").collect()]
    pairs = [
        (number(r["f"], "<i4"), number(r["r"], "<f4"), number(r["f2"], "<i4"), number(r["r2"], "<f4"))
        for r in seen.where("y is null").orderBy("h", "f", "r", "f2").limit(sample).collect()
    ]
    return fit(found, pairs, chosen, **options)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))],
                    names=["doc_id", "score"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scorer(shared), "doc_id long, score double"
    )


def held_out(column="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) == 1, F.lit(False))


def op5_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model of the labelled ones that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out()).select("doc_id", "toxic"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
