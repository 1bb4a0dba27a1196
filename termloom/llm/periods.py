"""Periodic runs by heavy and light lag counting.

A run of period q is a stretch whose words q apart are equal, so at lag q it is an
island of equal pairs. For every text and lag the equal pairs are counted exactly: by
one autocorrelation, from Fourier transforms, of the words so frequent that this is
cheaper than their pairs, and by differences of positions for all others. A lag is
scanned for islands only where its pairs suffice for a run: 3q of them, and 5.

Lags are taken from small to large, and a run's own pairs at multiples of its period
are taken off their counts: a run of a larger period shares less than that period with
it, so what is left must still suffice. Of a lag q, pairs are first compared at every
q-th place; an island of a run has three of those in a row, and only the stretches
around such are compared whole. All texts of a slice are worked on together.

Defined cases: null, empty and white text has no words and no run; a null doc_id stays;
repeated rows have a row each; an empty table gives no rows; other columns are ignored,
so their names cannot clash. Runs shorter than least words or of fewer than times
periods are none. Texts of any length are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import slices, split_words
from termloom.session import ship

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 6, 4
#: Lags from here on are compared at every lag-th place first.
COARSE = 16
ROWS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, n_kept long, collapsed string"


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, size of them, end to end."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def need(lag: int, least: int = LEAST, times: int = TIMES) -> int:
    """Equal pairs in a row that the shortest run of this period has."""
    return max(least, times * lag) - lag


def lag_counts(codes: np.ndarray, starts: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Equal pairs at each lag up to a text's length over times: where each text's counts begin, by lag, and the counts."""
    sizes = np.diff(starts)
    most = sizes // times
    base = np.concatenate([[0], np.cumsum(most + 1)])
    counts = np.zeros(base[-1], np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((codes, text))  # stable, so positions of a word increase
    same = np.flatnonzero(np.diff(codes[order]) | np.diff(text[order])) + 1
    first = np.concatenate([[0], same])
    size = np.diff(np.concatenate([first, [len(codes)]]))
    if not len(codes):
        return base, counts
    # n log n for a transform against half the square of a word's count for its pairs
    n = sizes[text[order[first]]]
    heavy = size > np.sqrt(2 * n * np.log2(n + 2)) + 32
    for t in np.unique(text[order[first[heavy]]]):
        at = first[heavy & (text[order[first]] == t)]
        length = 1 << int(2 * sizes[t] - 1).bit_length()
        power = np.zeros(length // 2 + 1)
        for a in at:
            k = size[np.searchsorted(first, a)]
            line = np.zeros(length)
            line[order[a : a + k] - starts[t]] = 1
            wave = np.fft.rfft(line)
            power += wave.real**2 + wave.imag**2
        # counts are whole numbers far below 2**53, so rounding gives them exactly
        counts[base[t] : base[t + 1]] += np.rint(np.fft.irfft(power, length)[: most[t] + 1]).astype(np.int64)
    light = ~heavy & (size > 1)
    left = _spread(first[light], size[light] - 1)
    end = np.repeat(first[light] + size[light], size[light] - 1)
    step = 1
    while len(left):
        lag = order[left + step] - order[left]
        t = text[order[left]]
        near = lag <= most[t]  # differences grow with the step
        left, end = left[near], end[near]
        np.add.at(counts, base[t[near]] + lag[near], 1)
        step += 1
        inside = left + step < end
        left, end = left[inside], end[inside]
    counts[base[:-1]] = 0
    return base, counts


def _islands(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, lag: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places begin, begin + step, ... (size of them): which stretch, from where, and how many in a row equal the word lag on."""
    place = np.repeat(begin, size) + step * (_spread(np.zeros(len(size), np.int64), size))
    owner = np.repeat(np.arange(len(size)), size)
    equal = codes[place] == codes[place + lag]
    edge = np.concatenate([[True], np.diff(owner) != 0]) if len(owner) else np.zeros(0, bool)
    before = np.concatenate([[False], equal[:-1]]) & ~edge
    on = np.flatnonzero(equal & ~before)
    stop = ~equal | edge
    ends = np.append(np.flatnonzero(stop), len(equal))
    off = ends[np.searchsorted(ends, on, side="right")]
    return owner[on], place[on], off - on


def runs_of(codes: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text that has any, by start and period. Text t has codes[starts[t] : starts[t + 1]]."""
    sizes = np.diff(starts)
    base, counts = lag_counts(codes, starts, times)
    text = np.repeat(np.arange(len(sizes)), np.diff(base))
    lags = np.arange(len(counts)) - base[text]
    fit = (lags > 0) & (counts >= np.maximum(least, times * lags) - lags)
    order = np.flatnonzero(fit)[np.argsort(lags[fit], kind="stable")]
    cuts = np.flatnonzero(np.diff(lags[order])) + 1
    out: dict[int, list[tuple[int, int, int]]] = {}
    for some in np.split(order, cuts) if len(order) else []:
        lag = int(lags[some[0]])
        least_pairs = need(lag, least, times)
        some = some[counts[some] >= least_pairs]  # what runs of smaller periods leave
        own = text[some]
        begin, size = starts[own], sizes[own] - lag
        if lag >= COARSE and times >= 4:
            # at every lag-th place; of (times - 1) * lag equal pairs in a row, times - 1 are there
            k, at, many = _islands(codes, begin, -(-size // lag), lag, lag)
            good = many >= times - 1
            k, at, many = k[good], at[good], many[good]
            low = np.maximum(at - lag + 1, begin[k])
            size = np.minimum(at + many * lag, begin[k] + size[k]) - low
            own, begin = own[k], low
        k, at, pairs = _islands(codes, begin, size, lag, 1)
        good = pairs >= least_pairs
        for t, a, n in zip(own[k[good]].tolist(), at[good].tolist(), pairs[good].tolist(), strict=True):
            start, length = a - int(starts[t]), n + lag
            found = out.setdefault(t, [])
            if any(lag % q == 0 and s <= start and start + length <= s + m for s, m, q in found):
                continue
            found.append((start, length, lag))
            more = np.arange(2 * lag, min(length, int(base[t + 1] - base[t])), lag)
            counts[base[t] + more] -= length - more
    return {t: sorted(x, key=lambda r: (r[0], r[2])) for t, x in out.items()}


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run has after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def repeated_tails(starts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which word each word becomes in a text whose number h ends in 0: from a place on, the first of them over and over.

    With g = h // 10 and n words, words from a = g % n on have period 1 + (n - a) // (3 + g % 8).
    """
    out = np.arange(starts[-1])
    for t in np.flatnonzero((h >= 0) & (h % 10 == 0) & (np.diff(starts) > 0)):
        g, n = int(h[t]) // 10, int(starts[t + 1] - starts[t])
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[starts[t] + a : starts[t + 1]] = starts[t] + a + np.arange(n - a) % p
    return out


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "length", "period")
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in names]))
        for whole in batches:
            for batch in slices(whole):
                words = split_words(batch.column("text"))
                h = pc.fill_null(batch.column("h"), -1).to_numpy(zero_copy_only=False)
                codes = words.codes[repeated_tails(words.starts, h)]
                found = runs_of(codes, words.starts, least, times)
                kept = np.ones(len(codes), bool)
                for t, runs in found.items():
                    a, b = words.starts[t], words.starts[t + 1]
                    kept[a:b] = kept_words(int(b - a), runs)
                edges = np.concatenate([[0], np.cumsum(kept)])[words.starts]
                left = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words.words.take(pa.array(codes[kept])))
                some = [[dict(zip(names, r, strict=True)) for r in found.get(t, [])] for t in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(words.counts),
                        pa.array(some, kind),
                        pa.array(np.diff(edges)),
                        pc.binary_join(left, " "),
                    ],
                    names=["doc_id", "n_words", "runs", "n_kept", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, number: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """For every document its runs, by start and period, and its words without those that repeat a period, joined by one space.

    number: a column of docs by which repeated_tails puts known runs into some texts first.
    """
    ship(docs.sparkSession)
    h = (F.lit(None) if number is None else number).cast("long").alias("h")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), h).mapInArrow(_found(least, times), ROWS)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The longest run of every document, and digests of all its runs and of what is left; a tenth get a periodic tail by the checksum of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = periodic_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.array_min(order)
    return rows.select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        (-best["less"]).alias("length"),
        best["period"].alias("period"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).withColumn("exponent_milli", F.expr("1000 * length div period"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(xor(list_reduce([4294967295::UBIGINT] || list_transform(
           string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
           lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))), 4294967295::UBIGINT), 1)::BIGINT AS h
  FROM documents
), t AS (
  SELECT *, len(w) AS n, h // 10 AS g FROM d
), t2 AS (
  SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM t
), t3 AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM t2
), word AS (
  SELECT r, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM t3)
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q
  FROM word x JOIN word y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), island AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs)
  GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (
  SELECT * FROM island x WHERE NOT EXISTS (
    SELECT 1 FROM island y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0
      AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
), gone AS (
  SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM run
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
         arg_min({'start': start, 'length': length, 'q': q}, {'l': -length, 's': start, 'q': q}) AS best
  FROM run GROUP BY r
), left_ AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM word ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start,
       best.length::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.length // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM t3 LEFT JOIN told USING (r) LEFT JOIN left_ USING (r)
"""
