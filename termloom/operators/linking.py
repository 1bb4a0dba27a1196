"""Entity linking by a dictionary of phrases, and what stands around mentions.

A name's phrase is its tokens. Places of a text whose word begins a phrase meet the
phrases of that first word by length, so only windows that may be a name are made; a
text's overlapping finds are then settled from the left, the longest first. No text is
paired with a name that shares no first word with it.

Positions are places among a text's tokens, from 0. Names without a token have no
phrase; names of equal phrase are all linked, until confidence tells between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as tx
from termloom.operators.search import FEW
from termloom.session import ship

#: Confidence that an annotation must exceed.
RHO = 0.2
#: Code points of a block in which spans of characters meet.
BLOCK = 64


def phrases(names: DataFrame) -> DataFrame:
    """(name, first, k, phrase): the dictionary of names (name)."""
    t = names.select("name").distinct().withColumn("_t", tx.tokens(F.replace("name", F.lit("_"), F.lit(" "))))
    return t.where(F.size("_t") > 0).select("name", F.get("_t", F.lit(0)).alias("first"), F.size("_t").alias("k"), F.array_join("_t", " ").alias("phrase"))


def windows(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, k, phrase): every place of a text that has the words of a phrase, overlapping or not."""
    known = dictionary.select("first", "k", "phrase").distinct()
    heads = known.select("first", "k").distinct()
    longest = heads.agg(F.max("k")).first()[0] or 1
    tokens = docs.select(key, F.explode(F.array(tx.tokens("text"))).alias("_t"))
    # a row a place, with the words that the longest phrase could have there
    at = F.transform("_t", lambda x, i: F.struct(i.alias("pos"), x.alias("first"), F.slice("_t", i + 1, F.lit(longest)).alias("rest")))
    if longest == 1:
        at = F.transform("_t", lambda x, i: F.struct(i.alias("pos"), x.alias("first")))
    places = tokens.select(key, F.explode(at).alias("_p")).select(key, "_p.*")
    begun = places.join(heads, "first")
    if longest == 1:
        return begun.select(key, "pos", "k", F.col("first").alias("phrase"))
    begun = begun.where(F.col("k") <= F.size("rest")).select(key, "pos", "k", F.array_join(F.slice("rest", F.lit(1), F.col("k")), " ").alias("phrase"))
    # a first word alone is its phrase
    return begun.where("k = 1").unionByName(begun.where("k > 1").join(known.where("k > 1").select("phrase"), "phrase", "left_semi"))


def settled(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of overlapping spans (key, pos, k, ...) those met from the left: of each place the longest, then on from its end.

    Spans that overlap in a chain are settled together, others stand alone; a window
    over a text's finds tells where a chain ends.
    """
    best = found.groupBy(key, "pos").agg(F.max(F.struct("k", "phrase")).alias("_s")).select(key, "pos", "_s.*")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.max(F.col("pos") + F.col("k")).over(before)
    chained = best.withColumn("_new", F.when(end > F.col("pos"), 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(upto))
    chains = chained.groupBy(key, "_chain").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "phrase"))).alias("_l"))
    none = F.slice("_l", F.lit(1), F.lit(0))
    walk = F.aggregate(
        "_l",
        F.struct(F.lit(0).alias("end"), none.alias("kept")),
        lambda s, x: F.when(x["pos"] >= s["end"], F.struct((x["pos"] + x["k"]).alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    kept = F.when(F.size("_l") == 1, F.col("_l")).otherwise(walk)
    return chains.select(key, F.explode(kept).alias("_s")).select(key, "_s.*")


def spans(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, k, phrase): the mentions of a text, none over another.

    Up to FEW phrases are told to tasks, which settle a text's finds where it lies; more
    are joined, and then equal keys are one text.
    """
    told = _told(dictionary)
    if told is None:
        return settled(windows(docs, dictionary, key), key)
    held = docs.select(key, tx.tokens("text").alias("t"))
    return held.mapInArrow(_spotter(told), f"{key} {dict(held.dtypes)[key]}, pos int, k int, phrase string")


def ball_counts(docs: DataFrame, dictionary: DataFrame, reach: int = 4, key: str = "doc_id") -> DataFrame:
    """(phrase, term, tf, mentions): the terms within reach of a phrase's mentions, and how many mentions have each.

    Tasks count the balls of a batch of texts; texts and mentions are not shuffled.
    """
    told = _told(dictionary)
    if told is None:
        found = spans(docs, dictionary, key).groupBy(key).agg(F.collect_list(F.struct("pos", "k", "phrase")).alias("_m"))
        t = docs.join(found, key).select(F.explode(F.array(F.struct(tx.tokens("text").alias("t"), "_m"))).alias("x"))
        marked = t.select("x.t", F.explode("x._m").alias("m"))
        ball = marked.select("m.phrase", tx.token_ball("t", F.col("m.pos"), F.col("m.pos") + F.col("m.k"), reach).alias("b"))
        one = lambda tf, n: lambda x: F.struct(x.alias("term"), F.lit(tf).alias("tf"), F.lit(n).alias("n"))
        rows = ball.select("phrase", F.explode(F.concat(F.transform("b", one(1, 0)), F.transform(F.array_distinct("b"), one(0, 1)))).alias("r"))
        rows = rows.select("phrase", "r.term", "r.tf", F.col("r.n").alias("mentions"))
    else:
        held = docs.select(tx.tokens("text").alias("t"))
        rows = held.mapInArrow(_balls(told, reach), "phrase string, term string, tf long, mentions long")
    return rows.groupBy("phrase", "term").agg(F.sum("tf").alias("tf"), F.sum("mentions").alias("mentions"))


def _told(dictionary: DataFrame) -> list[str] | None:
    """The phrases of a dictionary that has FEW at most."""
    known = dictionary.select("phrase").distinct().limit(FEW + 1).collect()  # FEW rows and one at most
    if len(known) > FEW:
        return None
    ship(dictionary.sparkSession)
    return sorted(x[0] for x in known)


class _Batch:
    """The tokens of a batch of texts as numbers, with the spans of phrases in them, settled."""

    def __init__(self, lists: pa.Array, told: list[str]):
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        tokens = lists.flatten().dictionary_encode()
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        self.begin = np.cumsum(sizes) - sizes
        self.end = self.begin + sizes
        self.ids, self.words = np.asarray(tokens.indices).astype(np.int64), tokens.dictionary
        self.at, self.k, self.phrase = self._spans(told)

    def _spans(self, told: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where spans begin, their lengths, and their places in told."""
        words, many = {w: i for i, w in enumerate(self.words.to_pylist())}, len(self.words)
        # a trie of the phrases whose words all occur: 0 is its root
        below: dict[int, int] = {}
        ends = [-1]
        for place, phrase in enumerate(told):
            path = [words.get(w) for w in phrase.split(" ")]
            if None in path:
                continue
            node = 0
            for w in path:
                node = below.setdefault(node * many + w, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = place
        if not below:
            return (np.empty(0, np.int64),) * 3
        codes = np.array(sorted(below), np.int64)
        nodes, ends = np.array([below[c] for c in codes.tolist()], np.int64), np.array(ends, np.int64)
        more = np.zeros(len(ends), bool)
        more[codes // many] = True
        k, best = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), -1, np.int64)
        at, node, step = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64), 0
        while len(at):
            inside = at + step < self.end[self.rows[at]]
            at, node = at[inside], node[inside]
            code = node * many + self.ids[at + step]
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[place] == code
            at, node, step = at[hit], nodes[place[hit]], step + 1
            whole = ends[node] >= 0
            k[at[whole]], best[at[whole]] = step, ends[node[whole]]
            at, node = at[more[node]], node[more[node]]
        # only spans of several words lie over others
        over, stop = np.zeros(len(k) + 1, np.int64), -1
        for i in np.flatnonzero(k > 1).tolist():
            if i >= stop:
                stop = i + int(k[i])
                over[i + 1] += 1
                over[stop] -= 1
        kept = np.flatnonzero((k > 0) & (np.cumsum(over[:-1]) == 0))
        return kept, k[kept], best[kept]


def _spotter(told: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (key, tokens): rows (key, pos, k, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = pa.array(told, pa.string())
        for batch in batches:
            b = _Batch(batch.column(1), told)
            row = b.rows[b.at]
            columns = [batch.column(0).take(pa.array(row)), pa.array((b.at - b.begin[row]).astype(np.int32)), pa.array(b.k.astype(np.int32)), phrases.take(pa.array(b.phrase))]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "pos", "k", "phrase"])

    return run


def _balls(told: list[str], reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (tokens): rows (phrase, term, tf, mentions), counted over the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = pa.array(told, pa.string())
        for batch in batches:
            b = _Batch(batch.column(0), told)
            row, many = b.rows[b.at], max(1, len(b.words))
            low, high = np.maximum(b.at - reach, b.begin[row]), np.minimum(b.at + b.k + reach, b.end[row])
            size = high - low
            span = np.repeat(np.arange(len(size)), size)
            word = b.ids[np.arange(len(span)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
            cell, tf = np.unique(b.phrase[span] * many + word, return_counts=True)
            once = np.unique(span * many + word)
            _, mentions = np.unique(b.phrase[once // many] * many + once % many, return_counts=True)
            columns = [phrases.take(pa.array(cell // many)), b.words.take(pa.array(cell % many)), pa.array(tf.astype(np.int64)), pa.array(mentions.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["phrase", "term", "tf", "mentions"])

    return run


def mentions(found: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, n): how often a text mentions each name."""
    return found.groupBy(key, "phrase").agg(F.count("*").alias("n")).join(dictionary.select("name", "phrase"), "phrase").select(key, "name", "n")


def confidence(found: DataFrame, dictionary: DataFrame, links: DataFrame) -> DataFrame:
    """(phrase, name, rho): for each phrase the name that is linked most, and how surely a mention means it.

    rho is the share of a phrase's occurrences that are links, times the share of
    those links that go to the name. links has a row a link (name).
    """
    linked = dictionary.join(links.groupBy("name").agg(F.count("*").alias("linked")), "name").select("phrase", "name", "linked")
    occurs = found.groupBy("phrase").agg(F.count("*").alias("occurs"))
    whole = linked.groupBy("phrase").agg(F.sum("linked").alias("all"), F.min(F.struct((-F.col("linked")).alias("less"), "name")).alias("best"))
    most = -F.col("best.less")
    # most / all * all / (all + occurs)
    rho = most / (F.col("all") + F.col("occurs"))
    return whole.join(occurs, "phrase").select("phrase", F.col("best.name").alias("name"), rho.alias("rho"))


def annotations(found: DataFrame, dictionary: DataFrame, links: DataFrame, least: float = RHO, key: str = "doc_id") -> DataFrame:
    """(key, pos, k, name, rho): mentions whose confidence exceeds least, each with one name."""
    sure = confidence(found, dictionary, links).where(F.col("rho") > least)
    return found.join(sure, "phrase").select(key, "pos", "k", "name", "rho")


# -- around mentions -----------------------------------------------------------


def token_offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, term, begin, end): a text's tokens and the characters that they take, end exclusive."""
    runs = F.regexp_extract_all("text", F.lit(rf"{tx.TOKEN}|[^\p{{L}}\p{{N}}]+"), F.lit(0))
    rows = docs.select(key, F.posexplode(runs).alias("_i", "_run"))
    upto = Window.partitionBy(key).orderBy("_i")
    word = F.col("_run").rlike(rf"^{tx.TOKEN}")
    rows = rows.select(
        key, F.lower("_run").alias("term"), word.alias("_word"), F.sum(F.length("_run")).over(upto).alias("end"),
        F.length("_run").alias("_n"), (F.sum(word.cast("int")).over(upto) - 1).alias("pos"),
    )
    return rows.where("_word").select(key, F.col("pos").cast("int").alias("pos"), "term", (F.col("end") - F.col("_n")).alias("begin"), "end")


def covered(tokens: DataFrame, marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, begin, end, pos, k): the tokens that spans of characters (key, name, begin, end) touch.

    An interval join: tokens and spans meet in blocks of characters that both touch,
    so a span meets the tokens near it and no others.
    """
    blocks = F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    a = tokens.select(key, F.col("pos").alias("_pos"), F.col("begin").alias("_b"), F.col("end").alias("_e"), F.explode(blocks).alias("_block"))
    b = marked.where("end > begin").select(key, "name", "begin", "end", F.explode(blocks).alias("_block"))
    met = b.join(a, [key, "_block"]).where((F.col("_b") < F.col("end")) & (F.col("_e") > F.col("begin")))
    out = met.groupBy(key, "name", "begin", "end").agg(F.min("_pos").alias("pos"), (F.max("_pos") - F.min("_pos") + 1).alias("k"))
    return out


def balls(tokens: DataFrame, marked: DataFrame, reach: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, name, begin, terms): each marked span's tokens with reach before and after it, in order.

    A span asks for its places, which a text's tokens answer by an equi-join.
    """
    wide = F.sequence(F.greatest(F.col("pos") - reach, F.lit(0)), F.col("pos") + F.col("k") + reach - 1)
    asked = marked.select(key, "name", "begin", F.explode(wide).alias("pos"))
    rows = asked.join(tokens.select(key, "pos", "term"), [key, "pos"])
    return rows.groupBy(key, "name", "begin").agg(F.sort_array(F.collect_list(F.struct("pos", "term")))["term"].alias("terms"))
