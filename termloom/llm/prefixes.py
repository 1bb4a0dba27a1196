"""Token counts by prefix dynamic programming.

A table holds the exact number of tokens of every prefix of a text, so how many
tokens a text or a part of it has, and where it must end to keep a budget, is read
from the table; no text is encoded again.

White space ends a token, so a prefix has the tokens of its whole parts and those of
the part that it ends in. Within a part, the tokens of a prefix are those of a shorter
prefix and one more, its last: of the vocabulary's strings that end there, the only one
that byte-pair merges leave beside the shorter prefix's last token. That is told from
the two tokens alone: no merge over their border comes before the merges that made
them. A prefix's last symbol has the mark of a word's end, so each position has a last
token without the mark, on which longer prefixes build, and one with it, which counts.
Distinct parts are solved once a worker; a text's table is put together from them.

Defined cases: null text is empty and has the table of an empty text; a null doc_id
stays; repeated rows have a row each; an empty table gives no rows; other columns are
ignored. Positions are code points of the text as given. Within a part that the
normaliser shortens or lengthens (composed marks, say), prefixes are counted by the
library from the last pre-token on. The tokenizer must be a byte-level BPE with a mark
for ends of words behind the normaliser and pre-tokenizer below; others raise ValueError.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import buffers, held, slices
from termloom.session import ship

LIMIT = 2048
#: Distinct parts that a worker keeps; beyond it those of the last slice alone stay.
CACHE = 3 << 18
#: Distinct pre-tokens that a worker keeps, likewise.
WORDS = 3 << 18
#: Code points of parts that a worker keeps.
CACHE_CHARS = 16 << 20
SLICE = 4 << 20
TABLE = "doc_id long, n_bytes long, n_tokens long, width int, steps binary"

#: Fixed value: the pre-token pattern of lower-case word-end vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for characters that the normaliser only lowers, one by one.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*").fullmatch
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall
#: Of these, a prefix of two characters is two pre-tokens.
_SPLIT = ("'re", "'ve", "'ll")


class Counter:
    """Tokens of every prefix of a pre-token, under merges of byte-level symbols."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # one thread a worker: Spark runs as many workers as there are cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.mark = model.get("end_of_word_suffix") or ""
        split, steps = self._known(told)
        plain = all(not t[k] for t in told.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (self.mark and split == PATTERN and steps == ["NFC", "Replace", "Lowercase"] and plain):
            raise ValueError(f"{path} is no lower-case byte-level BPE with marked ends of words")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # part() knows special strings
        self.vocab: dict[str, int] = model["vocab"]
        self.longest = max(len(t.removesuffix(self.mark)) for t in self.vocab)
        self._strings: dict[str, tuple[int, int]] = {}  # ids without and with the mark, -1 where there is none
        for t in self.vocab:
            plain = t.removesuffix(self.mark)
            self._strings[plain] = (self.vocab.get(plain, -1), self.vocab.get(plain + self.mark, -1))
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = self.vocab[a], self.vocab[b]
            self.rank[x, y] = r
            if self.halves.setdefault(self.vocab[a + b], (x, y, r))[2] != r:
                raise ValueError(f"{path} merges {a + b} in two ways")
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.byte = [chr(b) if b in own else chr(next(other)) for b in range(256)]
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._beside: dict[int, bool] = {}
        self._words: dict[str, bytes | list[int]] = {}

    @staticmethod
    def _known(told: dict) -> tuple[str | None, list[str]]:
        """The pattern that splits, where it is used as expected, and the normaliser's steps."""
        pre = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norm = (told.get("normalizer") or {}).get("normalizers", [])
        fits = (
            [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["invert"]
            and pre[0]["behavior"] == "Removed"
            and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"]
            and told["model"]["type"] == "BPE"
            and not told["model"].get("dropout")
            and not told["model"].get("continuing_subword_prefix")
            and all(n["type"] != "Replace" or (n["pattern"], n["content"]) == ({"Regex": r"\s+"}, " ") for n in norm)
        )
        return (pre[0]["pattern"].get("Regex") if fits else None), [n["type"] for n in norm]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols at a token's border as merges make it, largest first, each with the rank at which it is used up."""
        out, used = [(token, float("inf"))], self.halves.get(token)
        while used:
            out.append((used[side], used[2]))
            used = self.halves.get(used[side])
        return out

    def beside(self, a: int, b: int) -> bool:
        """Whether merges leave a and b as two tokens beside each other.

        A merge over the border of rank m takes place if both its symbols are there
        then; equal pairs merge from the left, so of equal ranks the left one is first.
        """
        key = a << 32 | b
        found = self._beside.get(key)
        if found is None:
            if (right := self._right.get(a)) is None:
                right = self._right[a] = self._spine(a, 1)
            if (left := self._left.get(b)) is None:
                left = self._left[b] = self._spine(b, 0)
            found, rank = True, self.rank.get
            for x, x_until in right:
                for y, y_until in left:
                    m = rank((x, y))
                    if m is not None and m < x_until and m <= y_until:
                        found = False
            self._beside[key] = found
        return found

    def prefixes(self, words: list[str]) -> Iterator[list[int]]:
        """Tokens of each prefix of pre-tokens given as byte-level symbols; what one shares with the one before isn't solved again."""
        known, told, beside, longest = self._strings.get, self._beside.get, self.beside, self.longest
        past, last, count, out = "", [-1], [0], []
        for word in words:
            same = len(os.path.commonprefix((past, word)))
            del last[same + 1 :], count[same + 1 :], out[same:]
            for i in range(same + 1, len(word) + 1):
                opened = closed = -1
                for k in range(max(0, i - longest), i):
                    found = known(word[k:i])
                    if found is None:
                        continue
                    plain, marked = found
                    before = last[k] << 32
                    if opened < 0 <= plain and (k == 0 or ((x := told(before | plain)) is None and beside(last[k], plain)) or x):
                        opened, n = plain, count[k] + 1
                        if closed >= 0:
                            break
                    if closed < 0 <= marked and (k == 0 or ((x := told(before | marked)) is None and beside(last[k], marked)) or x):
                        closed = count[k] + 1
                        if opened >= 0:
                            break
                last.append(opened)
                count.append(n)
                out.append(closed)
            past = word
            yield out.copy()

    def solved(self, words: list[str]) -> dict[str, bytes | list[int]]:
        """Tokens of each prefix of normalised pre-tokens, by code point; those of these words are there, and of some others."""
        if len(self._words) > WORDS:
            self._words = {}
        known = self._words
        fresh = [w for w in words if w not in known]
        symbols = {w: w if w.isascii() and w.isprintable() else "".join([self.byte[b] for b in w.encode()]) for w in fresh}
        fresh.sort(key=symbols.__getitem__)
        for w, told in zip(fresh, self.prefixes([symbols[w] for w in fresh]), strict=True):
            if not w.isascii():
                told = [told[k - 1] for k in accumulate(len(c.encode()) for c in w)]
            elif w in _SPLIT:
                told[1] = 1 + next(self.prefixes([w[1]]))[0]
            known[w] = bytes(told) if max(told) < 256 else told
        return known

    def words(self, part: str) -> list[str] | None:
        """The normalised pre-tokens of a part without white space, none where positions in it move."""
        if _PLAIN(part):
            return _PLAIN_WORDS(part.lower())
        norm = self.library.normalizer.normalize_str(part)
        if len(norm) != len(part) or not unicodedata.is_normalized("NFC", part) or any(len(c.lower()) != 1 for c in part):
            return None
        words = [norm[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return words if sum(map(len, words)) == len(norm) else None  # white space beyond ASCII

    def ordinary(self, part: str) -> list[int]:
        """Tokens of each prefix of a part without white space, special strings taken as any other."""
        words = self.words(part)
        return self._by_library(part) if words is None else joined(words, self.solved(words))

    def _by_library(self, part: str) -> list[int]:
        """The same where normalising moves positions: each prefix from the last pre-token on."""
        whole = self.library.encode(part, add_special_tokens=False)
        begun, end, last = [(0, 0)], 0, None
        for n, (word, (at, stop)) in enumerate(zip(whole.word_ids, whole.offsets, strict=True)):
            if word != last and at >= end:  # else one code point has symbols of two pre-tokens
                begun.append((at, n))
            end, last = max(end, stop), word
        out = []
        for (at, before), (stop, _) in zip(begun, [*begun[1:], (len(part), 0)], strict=True):
            some = [part[at:k] for k in range(at + 1, stop + 1)]
            out += [before + len(x.ids) for x in self.library.encode_batch(some, add_special_tokens=False)]
        return out

    def with_special(self, part: str) -> list[int]:
        """The same, but a special string is one token where it ends."""
        out, base, rest = [], 0, part
        while rest:
            at, found = min(((k, x) for x in self.special if (k := rest.find(x)) >= 0), default=(len(rest), ""))
            told = self.ordinary(rest[: at + len(found)])
            if found:
                told[-1] = (told[at - 1] if at else 0) + 1
            out += [base + n for n in told]
            base, rest = out[-1], rest[at + len(found) :]
        return out

    def parts(self, parts: list[str]) -> list[list[int]]:
        """Tokens of each prefix of parts without white space."""
        special = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        cut = [None if special(p) else self.words(p) for p in parts]
        table = self.solved(list({w for words in cut if words for w in words}))
        return [self.with_special(p) if words is None else joined(words, table) for p, words in zip(parts, cut, strict=True)]


def joined(words: list[str], table: dict[str, bytes | list[int]]) -> list[int]:
    if len(words) == 1:
        return list(table[words[0]])
    out, base = [], 0
    for w in words:
        out += [base + n for n in table[w]]
        base = out[-1]
    return out


class Tables:
    """Tables of texts, put together from those of their distinct parts."""

    def __init__(self, path: str):
        self._counter = Counter(path)
        self._number: dict[str, int] = {}
        self._begin, self._size, self._steps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, parts: list[str]) -> np.ndarray:
        """Numbers of distinct parts; new ones are solved."""
        if len(self._number) + len(parts) > CACHE or len(self._steps) > CACHE_CHARS:
            self._number, self._steps = {}, self._steps[:0]
            self._begin, self._size = self._begin[:0], self._size[:0]
        known = self._number
        fresh = [p for p in parts if p not in known]
        if fresh:
            told = self._counter.parts(fresh)
            size = np.fromiter(map(len, told), np.int64, len(told))
            begin = np.cumsum(size) - size
            steps = np.fromiter(chain.from_iterable(told), np.int32, int(size.sum()))
            steps[1:] -= steps[:-1] * np.isin(np.arange(1, len(steps)), begin, invert=True)
            begin += len(self._steps)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self._steps = np.concatenate([self._steps, steps])
            self._begin, self._size = np.concatenate([self._begin, begin]), np.concatenate([self._size, size])
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For texts without nulls: where each one's steps begin, and the steps of all, a code point each.

        A step is by how much a prefix has more tokens than the one before it; white space adds none.
        """
        offsets, data = buffers(texts)
        data = data[offsets[0] : offsets[-1]]
        first = (data & 0xC0) != 0x80
        edges = np.concatenate([[0], np.cumsum(first)])[offsets - offsets[0]]
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        numbers = self._learn(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)]
        size = self._size[numbers]
        ends = np.cumsum(size)
        told = self._steps[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._begin[numbers] - ends + size, size)]
        points = data[first]
        steps = np.zeros(len(points), np.int32)
        steps[(points != 32) & ((points < 9) | (points > 13))] = told
        return edges, steps


def _kind(steps: np.ndarray) -> np.dtype:
    low, high = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
    return next(np.dtype(k) for k in ("<i1", "<i2", "<i4") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)


def _tables(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = held(f"prefixes {path}", lambda: Tables(path))
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                texts = pc.fill_null(batch.column("text"), "")
                edges, steps = made.of(texts)
                kind = _kind(steps)
                sums = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                data = pa.py_buffer(steps.astype(kind))
                places = pa.py_buffer((edges * kind.itemsize).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pc.cast(pc.binary_length(texts), pa.int64()),
                        pa.array(np.diff(sums[edges])),
                        pa.array(np.full(len(texts), kind.itemsize, np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(texts), [None, places, data]),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "width", "steps"],
                )

    return run


def prefix_tables(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """For every document its bytes, its tokens, and the table of its prefixes.

    steps holds, for each code point, how many tokens more the prefix that it ends has
    than the one before; little-endian integers of width bytes.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tables(tokenizer_path), TABLE)


def _unpacked(width: int, steps: bytes) -> np.ndarray:
    """Tokens of the prefix of each length, the empty one included."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)])


def _asked(width: Column, steps: Column, asked: Column, answer) -> Column:
    @F.pandas_udf("long")
    def run(w, s, a):
        return a.__class__([answer(_unpacked(int(x), bytes(y)), int(z)) for x, y, z in zip(w, s, a, strict=True)], dtype="int64")

    return run(width, steps, F.coalesce(asked.cast("long"), F.lit(0)))


def tokens_at(position: Column) -> Column:
    """Tokens of the prefix of a table's text with so many code points; beyond the end, those of the text."""
    return _asked(F.col("width"), F.col("steps"), position, lambda n, k: int(n[min(max(k, 0), len(n) - 1)]))


def longest_within(budget: Column) -> Column:
    """Code points of the longest prefix with at most so many tokens.

    Counts may fall as a prefix grows, when a word turns out to be a longer known one, so every prefix is looked at.
    """
    return _asked(F.col("width"), F.col("steps"), budget, lambda n, k: int(np.flatnonzero(n <= max(k, 0))[-1]))


def truncated(docs: DataFrame, tables: DataFrame, budget: int) -> DataFrame:
    """doc_id and the longest prefix of its text within the budget; doc_id must be a key of both."""
    at = tables.select("doc_id", longest_within(F.lit(budget)).alias("_at"))
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.join(at, "doc_id").select("doc_id", F.expr("substring(text, 1, int(_at))").alias("text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_prefix_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, read from the end of its table, and whether they exceed 2048."""
    tables = prefix_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
    return tables.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
