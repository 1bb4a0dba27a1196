"""Language of words in code-switched text by a linear-chain conditional random field.

A word's emission scores are sums of weights of its hashed features: itself (the
lexicon), prefixes and suffixes (affixes), and byte n-grams with word ends. With
learned transitions, forward-backward over a whole text gives each word a
distribution over languages; their mean over words with letters is the text's.

Training reads a bounded sample: at most SAMPLE_PER_LANG texts a language, and
SPANS spans of SPAN words from anywhere in each. Spans of different languages are
joined to switching sequences, so transitions are learned, not assumed.

Long texts are cut to segments whose transfer matrices are chained, which is exact:
the recursions run over all segments of a batch at once, and their number of steps
does not follow the longest text.

Defined cases: null texts, texts without a letter, and a model without languages
give "und" with score 0; repeated rows are judged row by row; a null doc_id is not
held out and never trains; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.words import buffers, column_of, held, mixed, slices, split_words
from termloom.session import ship

SAMPLE_PER_LANG = 600
SPANS, SPAN = 3, 40
BITS = 16
SEGMENT = 128
#: Bytes of the longest n-gram, and of the longest prefix and suffix with the mark of the word's end.
NGRAM, AFFIX = 4, 7
UND = "und"


# -- features ------------------------------------------------------------------


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids of each word: ids, the first of each word, whether it has a letter.

    Words are lowered and stripped of everything but letters first.
    """
    clean = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", "")
    offsets, data = buffers(clean)
    n = len(clean)
    size = np.diff(offsets)
    # ^ word $ with room for the longest n-gram
    span = size + 2
    start = np.concatenate([[0], np.cumsum(span)])
    text = np.zeros(start[-1] + AFFIX, np.uint64)
    word = np.repeat(np.arange(n), span)
    within = np.arange(start[-1]) - np.repeat(start[:-1], span)
    inner = (within > 0) & (within <= size[word])
    text[: start[-1]][within == 0] = 94
    text[: start[-1]][within == size[word] + 1] = 36
    if len(data):
        text[: start[-1]][inner] = data[offsets[0] : offsets[-1]]
    ids, owner = [], []
    room = span[word] - within
    h = np.zeros(start[-1], np.uint64)
    for k in range(AFFIX):
        h = h * np.uint64(0x100000001B3) + text[k : k + start[-1]] + np.uint64(1)
        if k == 0:
            continue
        # n-grams anywhere, longer ones where a word begins or ends
        ok = room > k if k < NGRAM else (room == k + 1) | ((within == 0) & (room > k))
        ids.append(mixed(h[ok] + np.uint64(k << 40)))
        owner.append(word[ok])
    whole = np.zeros(n, np.uint64)
    if start[-1]:
        powers = np.cumprod(np.full(int(span.max(initial=1)), 0x9E3779B1, np.uint64))
        np.add.at(whole, word, text[: start[-1]] * powers[within])
    ids.append(mixed(whole + np.uint64(9 << 40)))
    owner.append(np.arange(n))
    ids, owner = np.concatenate(ids) & np.uint64((1 << BITS) - 1), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(n))
    return ids[order].astype(np.int64), first, size > 0


def emissions(words: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each word for each language, 0 without a letter, and whether it has one."""
    if len(words) == 0:
        return np.zeros((0, weights.shape[1]), np.float32), np.zeros(0, bool)
    ids, first, letters = features(words)
    out = np.add.reduceat(weights[ids], first, axis=0)
    out[~letters] = 0
    return out, letters


# -- forward-backward ----------------------------------------------------------


def marginals(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Posterior of each word's label, for all texts at once; exact for any length."""
    return forward_backward(scores, starts, transitions, segment)[0]


def expected_pairs(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, segment: int = SEGMENT):
    """Posteriors, and how often each pair of neighbouring labels is expected: the gradient of the partition by transitions."""
    k = len(transitions)
    post, alpha, beta, x, m = forward_backward(scores, starts, transitions, segment)
    inside = np.ones(len(scores), bool)
    inside[starts[:-1][np.diff(starts) > 0]] = False
    b = np.flatnonzero(inside)
    if not len(b):
        return post, np.zeros((k, k))
    pair = alpha[b - 1][:, :, None] * m[None] * (x[b] * beta[b])[:, None, :]
    return post, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def forward_backward(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, segment: int):
    """Posteriors, forward and backward messages (each up to a factor), exponentials of scores and transitions."""
    n, k = scores.shape
    if n == 0:
        return scores, scores, scores, scores, np.exp(transitions)
    x = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    m = np.exp(transitions - transitions.max()).astype(np.float64)
    begin = np.zeros(n, bool)
    begin[starts[:-1][np.diff(starts) > 0]] = True
    lengths = np.diff(starts)
    pieces = -(-lengths // segment)
    text = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[:-1][text] + nth * segment
    size = np.minimum(segment, lengths[text] - nth * segment)
    order = np.argsort(-size, kind="stable")
    first, size, nth, text = first[order], size[order], nth[order], text[order]
    active = [int(np.searchsorted(-size, -j, side="left")) for j in range(segment + 1)]
    head = nth == 0
    flat = np.ones((k, k)) / k

    # transfer matrices of segments whose text has several
    multi = np.flatnonzero(pieces[text] > 1)
    place = np.full(len(text), -1)
    entry, leave = np.full((len(text), k), 1.0 / k), np.ones((len(text), k))
    if len(multi):
        p = np.broadcast_to(np.eye(k), (len(multi), k, k)).copy()
        s_first, s_size = first[multi], size[multi]
        for j in range(int(s_size.max())):
            live = int(np.searchsorted(-s_size, -j, side="left"))
            step = p[:live] @ m
            if j == 0:
                step[head[multi]] = flat
            step *= x[s_first[:live] + j][:, None, :]
            p[:live] = step / step.sum(axis=2, keepdims=True).max(axis=1, keepdims=True)
        place[multi] = np.arange(len(multi))
        # segment q of each text, in order of texts
        by = multi[np.lexsort((nth[multi], text[multi]))]
        at = np.flatnonzero(nth[by] == 0)
        last = np.concatenate([at[1:], [len(by)]])
        deep = int((last - at).max())
        for q in range(1, deep):
            go = at[last - at > q]
            a = np.einsum("sk,skj->sj", entry[by[go + q - 1]], p[place[by[go + q - 1]]])
            entry[by[go + q]] = a / a.sum(axis=1, keepdims=True)
        for q in range(deep - 1, 0, -1):
            go = at[last - at > q]
            b = np.einsum("skj,sj->sk", p[place[by[go + q]]], leave[by[go + q]])
            leave[by[go + q - 1]] = b / b.max(axis=1, keepdims=True)

    alpha, beta = np.empty((n, k)), np.empty((n, k))
    a = entry
    for j in range(segment):
        live = active[j]
        if not live:
            break
        a = a[:live] @ m
        if j == 0:
            a[head[:live]] = 1.0 / k
        a *= x[first[:live] + j]
        a /= a.sum(axis=1, keepdims=True)
        alpha[first[:live] + j] = a
    b = leave.copy()
    for j in range(segment - 1, -1, -1):
        live = active[j]
        if not live:
            continue
        at = first[:live] + j
        beta[at] = b[:live]
        b[:live] = (b[:live] * x[at]) @ m.T
        b[:live] /= b[:live].max(axis=1, keepdims=True)
    out = alpha * beta
    out /= out.sum(axis=1, keepdims=True)
    return out, alpha, beta, x, m


# -- the model -----------------------------------------------------------------


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def label(self, texts: pa.Array):
        """Words of the texts, the posteriors of each, and which have a letter."""
        w = split_words(texts)
        scores, letters = emissions(w.words, self.weights)
        return w, marginals(scores[w.codes], w.starts, self.transitions), letters[w.codes]


def fit(spans: list[tuple[str, str]], *, epochs: int = 4, rate: float = 0.08, decay: float = 1e-6, seed: int = 7) -> Crf:
    """A model of (language, span of words): Adam on the log-likelihood of switching sequences."""
    languages = sorted({x for x, _ in spans})
    k = len(languages)
    weights, transitions = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))
    if not k:
        return Crf([], weights, transitions)
    rng = np.random.default_rng(seed)
    at = {x: i for i, x in enumerate(languages)}
    words = split_words(pa.array([t for _, t in spans], pa.string()))
    ids, first, letters = features(words.words)
    ends = np.append(first[1:], len(ids))
    label = np.array([at[x] for x, _ in spans])
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        for batch in np.array_split(order, max(1, len(order) // 192)):
            group = np.cumsum(rng.random(len(batch)) < 0.6)  # runs of spans are one sequence
            codes = np.concatenate([words.codes[words.starts[s] : words.starts[s + 1]] for s in batch])
            size = words.counts[batch]
            if not len(codes):
                continue
            gold = np.repeat(label[batch], size)
            seq = np.repeat(group, size)
            starts = np.append(np.flatnonzero(np.diff(seq, prepend=-1)), len(seq))
            used, inverse = np.unique(codes, return_inverse=True)
            counts = ends[used] - first[used]
            flat = np.repeat(first[used] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            f, owner = ids[flat], np.repeat(np.arange(len(used)), counts)
            scores = np.add.reduceat(weights[f], np.cumsum(counts) - counts, axis=0)
            live = letters[used]
            scores[~live] = 0
            scores = scores[inverse]
            post, pairs = expected_pairs(scores, starts, transitions)
            delta = post.copy()
            delta[np.arange(len(gold)), gold] -= 1
            by_word = np.stack([np.bincount(inverse, delta[:, j], len(used)) for j in range(k)], axis=1)
            by_word[~live] = 0
            grad = np.stack([np.bincount(f, by_word[owner, j], 1 << BITS) for j in range(k)], axis=1) / len(codes)
            inside = np.ones(len(gold), bool)
            inside[starts[:-1]] = False
            b = np.flatnonzero(inside)
            seen = np.bincount(gold[b - 1] * k + gold[b], minlength=k * k).reshape(k, k)
            move = (pairs - seen) / max(1, len(b))
            step += 1
            for p, g, (u, v) in ((weights, grad + decay * weights, state[:2]), (transitions, move, state[2:])):
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                p -= (rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
            np.clip(transitions, -4, 4, out=transitions)
    return Crf(languages, weights, transitions)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each sampled text, from places that its id gives."""
    for batch in batches:
        lang, at, span = [], [], []
        for x, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True):
            words = text.split()
            rng = np.random.default_rng(h & 0xFFFFFFFF)
            for _ in range(SPANS):
                a = int(rng.integers(0, max(1, len(words) - SPAN + 1)))
                lang.append(x)
                span.append(" ".join(words[a : a + SPAN]))
                at.append(h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(at, pa.int64()), pa.array(span, pa.string())], names=["lang", "h", "span"]
        )


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANG) -> Crf:
    """A model from (doc_id, text, lang): a bounded sample by hash, whatever the table's size."""
    ship(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select(
        "text", "lang", F.xxhash64("doc_id", F.lit(11)).alias("h")
    )
    counts = rows.groupBy("lang").count()
    share = counts.select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share"))
    kept = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    # the hash keeps about per_language rows a language; where few ids repeat many times the least hashes stay
    bound = 2 * per_language * max(1, counts.count())
    found = kept.select("lang", "h", "text").mapInArrow(_spans, "lang string, h long, span string").where("span != ''")
    return fit(sorted((r[0], r[2]) for r in found.orderBy("h", "lang", "span").limit(bound * SPANS).collect()))


#: Text that is labelled at once; some 200 bytes of arrays a byte.
SLICE = 512 << 10


def _predictor(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language ID", object)  # lets go of what other operators keep
        model: Crf = shared.value
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                n, k = batch.num_rows, len(model.languages)
                pred, score, switches = [UND] * n, np.zeros(n), np.zeros(n, np.int64)
                if k:
                    w, post, letters = model.label(column_of(batch))
                    text = np.repeat(np.arange(n), w.counts)
                    real = np.flatnonzero(letters)
                    total = np.stack([np.bincount(text[real], post[real, j], n) for j in range(k)], axis=1)
                    many = np.bincount(text[real], minlength=n)
                    some = many > 0
                    best = total.argmax(axis=1)
                    score[some] = np.clip(total[some, best[some]] / many[some], 0, 1)
                    pred = [model.languages[b] if s else UND for b, s in zip(best, some, strict=True)]
                    named = post[real].argmax(axis=1)
                    moved = (np.diff(named) != 0) & (np.diff(text[real]) == 0)
                    switches = np.bincount(text[real][1:][moved], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [*map(batch.column, keep), pa.array(pred, pa.string()), pa.array(score), pa.array(switches)],
                    names=[*keep, "lang_pred", "score", "n_switches"],
                )

    return run


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score (mean posterior), n_switches (changes of language between words)."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _predictor(shared, ["doc_id"]), "doc_id long, lang_pred string, score double, n_switches long"
    )


def identified(docs: DataFrame, model: Crf) -> DataFrame:
    """own (all columns of docs, as a struct), lang_pred, score, n_switches; each text is sent once, in own."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*docs.columns).alias("own"))
    schema = T.StructType(
        [
            rows.schema["own"],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("n_switches", T.LongType()),
        ]
    )
    return rows.mapInArrow(_predictor(shared, ["own"]), schema)


def _labeller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Crf = shared.value
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                rows = []
                if model.languages:
                    w, post, _ = model.label(batch.column("text"))
                    named = post.argmax(axis=1)
                    for t, doc in enumerate(batch.column("doc_id").to_pylist()):
                        part = named[w.starts[t] : w.starts[t + 1]]
                        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                        rows += [(doc, a, b, model.languages[part[a]]) for a, b in zip(edges, edges[1:]) if a < b]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "first_word", "end_word", "lang"],
                )

    return run


def label_spans(docs: DataFrame, model: Crf) -> DataFrame:
    """Runs of words of one language: doc_id, first_word, end_word (exclusive), lang."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _labeller(shared), "doc_id long, first_word long, end_word long, lang string"
    )


def held_out(column="doc_id"):
    """Whether a document's label is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0, F.lit(False))


def op1_crf_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()).where("doc_id is not null").select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_switches")
