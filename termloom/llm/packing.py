"""Best-fit packing by bin completion.

Documents are tokenised once; every later step works on pieces, which are a few
numbers each. How many pieces there are of each length is all that packing needs,
and that histogram has as many rows as a sequence has tokens, whatever the corpus.
Branch and bound runs on it: the largest length left opens a bin, undominated
fillings of the rest are enumerated, a filling is used as often as the counts
allow, and a branch ends where the bins used and the bins that the tokens left need
reach the incumbent, which best-fit decreasing gives at first. Pieces then take
the places of their length by rank, without any bin being gathered anywhere.

Defined cases: null or empty text is the single end token; repeated documents are
packed as often as they occur; an empty table gives no rows; other columns are
ignored. Text of any length is cut to pieces, only the first of which may be short.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.words import held, released, slices
from termloom.session import ship, written

CAPACITY = 2048
END = 0
#: Code points of a part from which tokenizers encodes it: on long runs of white space the faster library's pattern fails.
LONG = 4096
#: Parts of texts whose ids a worker keeps; beyond it only those met lately are.
CACHE = 3 << 16
#: Text that is encoded at once.
SLICE = 6 << 20
#: Pieces of one length that are ranked in one task, about; a length has as many hash classes as that needs.
RANKED = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Characters that some table of white space, or of its neighbours, holds.
_SPACES = r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"
#: Fixed value: the pre-token pattern of byte-level vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands between parts that are encoded at once.
BETWEEN = "\U000f0000|\U000f0000"
_RUN = ".,;:!?#$%&*"
_MARKS = frozenset(_RUN)


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin : begin + size] of each, end to end."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)]


def known_split(told: dict) -> bool:
    """Whether a tokenizer's file splits texts by PATTERN and nothing else."""
    pre = told.get("pre_tokenizer") or {}
    return (
        told.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and told["model"].get("type", "BPE") == "BPE"
        and not any(told["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    )


class Tokens:
    """Ids of texts as a byte-level tokenizer of the tokenizers library gives them, a slice of texts at a time.

    Such a tokenizer begins a token at every space that no white space follows, and
    between a letter and a mark; no special string has either. So a text's ids are
    those of its parts between spaces, each encoded once with the space before it.
    Texts where white space follows a space are cut only where neither has any.
    Parts are numbered as they come; when there are many, those met again stay.

    New parts are merged by tiktoken under the file's own vocabulary, which gives the
    same ids several times faster; parts of LONG code points or more, texts with a
    special string, and all texts of a file that splits them in another way go to tokenizers.
    """

    def __init__(self, path: str):
        import tiktoken

        self._path, self._made = path, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        # a byte-level vocabulary writes each byte as a character: printable ones as themselves, the rest from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
        self._special = [t["content"] for t in told.get("added_tokens", [])]
        self._known = known_split(told)
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in told["model"]["vocab"].items() if t not in self._special}
        self._between = max(told["model"]["vocab"].values()) + 1
        self._fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={BETWEEN: self._between})
        del told, ranks
        released()
        self._number: dict[str, int] = {}
        self._again: list[str] = []
        self._ids, self._size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        python = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), _SPACES)
        self._cut = re.compile(f"(?<=[^{python}])(?= [^{python}])").split

    def _library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, end to end, and how many each has, by tokenizers itself; parts are words of one sequence."""
        if self._made is None:
            from tokenizers import Tokenizer

            self._made = Tokenizer.from_file(self._path)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        made = self._made.encode(parts, is_pretokenized=True, add_special_tokens=False)
        of = np.asarray(made.word_ids, np.int64)
        return np.asarray(made.ids, np.uint32), np.bincount(of, minlength=len(parts))

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text, by tokenizers itself."""
        self._library([])
        return np.asarray(self._made.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, parts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self._number)
        self._number.update(zip(parts, range(n, n + len(parts)), strict=True))
        self._ids, self._size = np.concatenate([self._ids, ids]), np.concatenate([self._size, size])

    def _encode(self, parts: list[str]) -> None:
        """New parts are encoded at once, kept apart by a string that none of them has."""
        long = [p for p in parts if len(p) >= LONG]
        if long:
            self._add(long, *self._library(long))
            parts = [p for p in parts if len(p) < LONG]
        joined = BETWEEN.join(parts)
        if not parts or joined.count(BETWEEN) != len(parts) - 1:
            self._add(parts, *self._library(parts))
            return
        ids = self._fast.encode_to_numpy(joined, allowed_special={BETWEEN})
        edges = np.flatnonzero(ids == self._between)
        size = np.diff(np.concatenate([[-1], edges, [len(ids)]])) - 1
        self._add(parts, np.delete(ids, edges), size)

    def _forget(self) -> None:
        """Keeps the parts that the last slice had and an earlier one too."""
        parts = self._again
        at = self.numbers(parts)
        ids, size = _gather(self._ids, self.begin()[at], self._size[at]), self._size[at]
        self._number, self._ids, self._size = {}, self._ids[:0], self._size[:0]
        self._add(parts, ids, size)

    def begin(self) -> np.ndarray:
        return np.cumsum(self._size) - self._size

    def numbers(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self._number.__getitem__, parts), np.int64, len(parts))

    def learn(self, parts: list[str]) -> None:
        """Numbers for distinct parts that have none; a letter's mark is encoded for itself."""
        known = self._number
        fresh = [p for p in parts if p not in known]
        if not fresh:
            return
        marked, base, mark = [], [], []
        for p in fresh:
            if p[-1:] in _MARKS and "a" <= (b := p.rstrip(_RUN))[-1:] < "\u0250" and b[-1].isalpha():
                marked.append(p)
                base.append(b)
                mark.append(p[len(b) :])
        plain = set(fresh).difference(marked)
        plain.update(base, mark)
        plain.difference_update(known)
        if plain:
            self._encode(list(plain))
        if marked:
            both = np.stack([self.numbers(base), self.numbers(mark)], axis=1).ravel()
            size = self._size[both]
            self._add(marked, _gather(self._ids, self.begin()[both], size), size[::2] + size[1::2])

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts, nulls as empty ones."""
        if not len(texts):
            return []
        if len(self._number) > CACHE:
            self._forget()
        texts = pc.fill_null(texts, "")
        if not self._known:
            return [self._whole(x).astype("<u4", copy=False).tobytes() for x in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, f" [{_SPACES}]")
        for x in self._special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        starts = np.asarray(lists.offsets, np.int64)
        coded = lists.flatten().dictionary_encode()
        starts = starts - starts[0]
        words = coded.dictionary.to_pylist()
        parts = list(map(" ".__add__, words))
        self._again = [p for p in parts if p in self._number]
        codes = np.asarray(coded.indices, np.int64)
        # the first part of a text has no space before it
        first = [words[k] for k in codes[starts[:-1]].tolist()]
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        whole = {t: texts[t].as_py() for t in at}
        told = {t: self._library(self._cut(x))[0] for t, x in whole.items() if any(y in x for y in self._special)}
        at = [t for t in at if t not in told]
        cut = [self._cut(whole[t]) for t in at]
        self.learn(list(dict.fromkeys([*parts, *first, *(p for c in cut for p in c)])))
        codes = self.numbers(parts)[codes]
        codes[starts[:-1]] = self.numbers(first)
        size, begin = self._size[codes], self.begin()
        flat = _gather(self._ids, begin[codes], size).astype("<u4", copy=False).tobytes()
        edges = (4 * np.concatenate([[0], np.cumsum(size)])[starts]).tolist()
        out = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for t, ids in told.items():
            out[t] = ids.astype("<u4", copy=False).tobytes()
        for t, c in zip(at, cut, strict=True):
            own = self.numbers(c)
            out[t] = _gather(self._ids, begin[own], self._size[own]).astype("<u4", copy=False).tobytes()
        return out


def _made(path: str) -> Tokens:
    # one thread a worker: Spark runs as many workers as there are cores
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(path)


def tokens_of(path: str) -> Tokens:
    return held(f"tokens {path}", lambda: _made(path))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for a shorter first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens_of(path)
        end = np.asarray([END], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                out: list[list[int]] = [[], [], [], [], []]
                made = tok.ids(batch.column("text"))
                for doc, told in zip(batch.column("doc_id").to_pylist(), made, strict=True):
                    ids = memoryview(told + end)
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        for column, value in zip(out, (doc, k, start, length, crc), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most capacity tokens, with the checksum of their ids."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _pieces(tokenizer_path, capacity), PIECES
    )


# -- the packing of a histogram ------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: fillings (lengths, decreasing) and how often each."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []

    def put(filling, n):
        gap = capacity - sum(filling)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_right(order, length - 1)
            if k == len(order):
                per = capacity // length
                if left >= per:
                    put((length,) * per, left // per)
                if left % per:
                    put((length,) * (left % per), 1)
                left = 0
                break
            gap = order[k]
            filling, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            used = min(n, left)
            put((*filling, length), used)
            if n > used:
                put(filling, n - used)
            left -= used
    return [x for fills in gaps.values() for x in fills]


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, ...]:
    """The filling of room that wastes least, of the largest items among such; exact.

    lengths increase. reach[k] has a bit for each sum that the k smallest can make.
    """
    if lengths and room <= lengths[-1] and counts.get(room, 0):
        return (room,)
    used = [x for x in lengths if x <= room]
    for x in reversed(used):
        if 2 * x < room:
            break
        if counts.get(room - x, 0) > (2 * x == room):
            return (x, room - x)
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in used:
        now, many, step = reach[-1], min(counts[x], room // x), 1
        while many:
            step = min(step, many)
            now |= (now << (x * step)) & mask
            many -= step
            step *= 2
        reach.append(now)
    left, out = reach[-1].bit_length() - 1, []
    for k in range(len(used), 0, -1):
        x = used[k - 1]
        for many in range(min(counts[x], left // x), -1, -1):
            if reach[k - 1] >> (left - many * x) & 1:
                out += [x] * many
                left -= many * x
                break
        if not left:
            break
    return tuple(out)


def every(lengths: list[int], counts: dict[int, int], room: int) -> Iterator[tuple[int, ...]]:
    """All fillings of room to which no item left can be added, larger items first. lengths increase."""
    order = lengths[::-1]
    chosen: list[int] = []  # how many of each length so far
    gap, down = room, True
    while True:
        while down and len(chosen) < len(order):
            x = order[len(chosen)]
            chosen.append(min(counts[x], gap // x))
            gap -= chosen[-1] * x
        if not any(x <= gap and counts[x] > n for x, n in zip(order, chosen, strict=True)):
            yield tuple(x for x, n in zip(order, chosen, strict=True) for _ in range(n))
        while chosen and not chosen[-1]:
            chosen.pop()
        if not chosen:
            return
        chosen[-1] -= 1
        gap += order[len(chosen) - 1]
        down = True


def fillings(lengths: list[int], counts: dict[int, int], room: int) -> Iterator[tuple[int, ...] | None]:
    """All fillings of room that none before dominates, the fullest first, made as they are asked for.

    None stands for one that was looked at and dominated, so a search can count it. lengths increase.
    """
    usable = [x for x in lengths if x <= room]
    out = [fullest(usable, counts, room)]
    yield out[0]
    for found in every(usable, counts, room):
        if any(dominates(f, found) for f in out):
            yield None
        else:
            out.append(found)
            yield found


#: Groupings of a filling's items that are tried; without a finding it counts as not dominated, which costs time alone.
GROUPINGS = 200


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether each item of b can be given to an item of a that holds all it is given."""
    if sum(b) > sum(a):
        return False
    items, room, tried = sorted(b, reverse=True), sorted(a), 0
    todo: list[tuple[int, int]] = []  # the item given last, and the place it has
    k = at = 0
    while True:
        while k < len(items):
            while at < len(room) and (room[at] < items[k] or at and room[at] == room[at - 1]):
                at += 1
            tried += 1
            if at == len(room) or tried > GROUPINGS:
                break
            room[at] -= items[k]
            todo.append((k, at))
            k, at = k + 1, 0
        else:
            return True
        if not todo or tried > GROUPINGS:
            return False
        k, at = todo.pop()
        room[at] += items[k]
        at += 1


def needed(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of bins: tokens that must be stored, and pieces that no two share a bin."""
    total = sum(k * n for k, n in counts.items())
    alone = sum(n for k, n in counts.items() if 2 * k > capacity)
    return max(-(-total // capacity), alone)


def bin_completion(
    counts: dict[int, int], capacity: int = CAPACITY, *, budget: int = 4_000
) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used: the fewest bins, or the best found within a budget of fillings looked at.

    Depth first; around the largest item all undominated fillings are tried, the fullest
    first, and each of them as often as counts allow, then less often. Best fit decreasing
    is the first incumbent; a branch ends where its bins and those that its tokens still
    need reach the incumbent, the search where an incumbent meets the lower bound.
    """
    left = {k: n for k, n in sorted(counts.items()) if n > 0}
    best, bound = best_fit(left, capacity), needed(left, capacity)
    best_bins, bins, total = sum(n for _, n in best), 0, sum(k * n for k, n in left.items())
    plan: list[tuple[tuple[int, ...], int]] = []
    open_choices: list[Iterator[tuple[tuple[int, ...], int] | None]] = []

    def options() -> Iterator[tuple[tuple[int, ...], int] | None]:
        counts = dict(left)
        top = max(x for x, n in counts.items() if n > 0)
        counts[top] -= 1
        some = [x for x, n in counts.items() if n > 0]
        for found in fillings(some, counts, capacity - top):
            if found is None:
                yield None
                continue
            whole = (top, *found)
            most = min((counts[x] + (x == top)) // whole.count(x) for x in set(whole))
            for times in range(most, 0, -1):
                yield whole, times

    def apply(filling: tuple[int, ...], times: int, sign: int) -> None:
        nonlocal bins, total
        for x in filling:
            left[x] -= sign * times
        bins += sign * times
        total -= sign * times * sum(filling)

    while best_bins > bound and budget > 0:
        if total and bins + max(-(-total // capacity), sum(n for k, n in left.items() if 2 * k > capacity)) < best_bins:
            open_choices.append(options())
        else:
            if not total and bins < best_bins:
                best, best_bins = list(plan), bins
            apply(*plan.pop(), -1)
        while open_choices and budget > 0:
            budget -= 1
            chosen = next(open_choices[-1], ())
            if chosen:
                apply(*chosen, 1)
                plan.append(chosen)
                break
            if chosen == ():
                open_choices.pop()
                if plan:
                    apply(*plan.pop(), -1)
        if not open_choices:
            break
    return best


# -- places for the pieces -----------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...).

    Only the histogram of lengths, at most capacity rows, comes to the driver. What
    goes back, a row for each place in each kind of filling, follows the number
    of lengths as well, not the number of pieces.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = bin_completion(counts, capacity)
    rows, taken, first = [], dict.fromkeys(counts, 0), 0
    for filling, times in plan:
        offset = 0
        for length in dict.fromkeys(filling):
            many = filling.count(length)
            rows.append((length, taken[length], taken[length] + times * many, first, many, offset))
            taken[length] += times * many
            offset += many * length
        first += times
    places = spark.createDataFrame(rows, "length long, lo long, hi long, first long, many long, at long")
    many = spark.createDataFrame([(k, 1 + n // RANKED) for k, n in counts.items()], "length long, _salts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), "_salts")
    # a row a length, of which there are at most as many as a sequence has tokens
    salted = pieces.join(F.broadcast(many), "length").withColumn("_salt", salt).drop("_salts")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(order) - 1)
        .join(base, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_base"))
    )
    fits = (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    at = F.col("_rank") - F.col("lo")
    return ranked.join(F.broadcast(places), fits).select(
        *[ranked[c] for c in pieces.columns],
        (F.col("first") + F.floor(at / F.col("many"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(at, F.col("many")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Whole documents to packed pieces; the pieces are stored once, tokens are not read again."""
    return pack(written(tokenized_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bin_completion_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
