"""Exact n-gram Jaccard join in metric space.

Jaccard distance is a metric, but almost all documents of a corpus are at distance
1 from each other, and from any document that is chosen as a pivot. Pivots that
part such a space are projections: shingles are dealt to so many parts that two
sets within the threshold must agree on a whole part (their difference has fewer
shingles than there are parts). Documents that agree on a part form a region;
every document is replicated to the regions of all its parts and, because the
triangle inequality bounds the sizes of linked sets, to those of two neighbouring
size windows. Within regions, pivots are documents: each member is compared with
the pivot that it shares most regions with, which joins most groups of copies at
once. What regions still hold in different components joins recursively: large
regions are dealt anew to more parts, of which each set shows only its rarest, and
regions take pivots until every pair of different components in them was compared,
by sizes and parity sketches first, which bound the distance, then by their sets.
Sketches grow with the sets, about 3 bits a shingle, so that they bound distances of
long texts too; only sets of pairs that sketches leave open are made and moved.
So no link between components is missed, and n copies mostly cost n comparisons.

Documents of equal sets are one class throughout; classes are what is joined.

Defined cases: null or empty text, and text without words, has an empty set, links
with nothing and is its own component; fewer words than a shingle make one shingle;
repeated rows and copies are linked; a null doc_id takes part but names no
component unless all of its component's ids are null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.graphs import components, swept
from termloom.llm.substrings import _only, keyed
from termloom.llm.words import BASE2, Spans, lower_ascii, mixed, position_in_text, signed, slices, split_words
from termloom.session import ship, written

SHINGLE, PERCENT = 3, 90
PROFILE = "doc_id long, key long, n long, node long, check long"
#: Pivots of an unresolved region in its first round; each later round takes as many times more.
PIVOTS = 64
#: Regions with more unresolved classes are dealt anew to finer ones before pivots are taken.
REGION = 4096
#: Dealings that are tried for a set with many empty parts.
SEEDS = 6
#: 64-bit words of a set's short parity sketch.
SKETCH = 8
#: Bits a shingle that a set's long parity sketch has at least; their number is a power of two.
WIDE = 2
#: Parts of the finer dealing for each one that a set has to show.
FINER = 4


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each begins."""
    w = split_words(lower_ascii(texts))
    h, counts = w.hashes(), w.counts
    within = position_in_text(w.starts)
    text = np.repeat(np.arange(len(counts)), counts)
    long = counts[text] >= k
    first = np.flatnonzero(np.where(long, within + k <= counts[text], within == 0))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    size = np.minimum(counts[text[first]], k)
    s = mixed(Spans(h, BASE2).of(first, first + size) + size.astype(np.uint64))
    owner = text[first]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    sets = [np.unique(s[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])


def size_levels(most: int, percent: int) -> np.ndarray:
    """Bounds of the size windows: sets within the threshold are in one or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1, (out[-1] * 100 // percent + 1) * 100 // percent + 1])


def _sums(values: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by group, modulo 2**64."""
    low = np.bincount(where, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(where, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def dealing(percent: int, levels: np.ndarray, meet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its number of parts, and how many of them a set may leave empty.

    Linked sets agree on more parts than a set within that margin leaves empty, so
    they agree on one that is not. The margin is somewhat more than the smallest
    set of the window leaves empty on average.
    """
    need = 2 * (100 - percent) * (levels[meet + 1] - 1) // (100 + percent) + 1
    least, margin = levels[np.maximum(meet - 1, 0)], np.zeros(len(meet), np.int64)
    for _ in range(12):
        margin = np.ceil(1.25 * (need + margin) * np.exp(-least / (need + margin))).astype(np.int64) + 2
        margin = np.minimum(margin, 2 * need + 2)
    return need + margin, margin


def signatures(sets: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Region keys of each set, end to end, and where each set's begin.

    A set that leaves more parts empty than the margin is dealt again with the next
    seed, and keeps the keys of both: of two linked sets the one that is done first
    meets the other at that seed. Sets that no seed serves share one region.
    """
    size = np.diff(bounds)
    docs = np.flatnonzero(size)
    if not len(docs):
        return np.zeros(0, np.uint64), np.zeros(len(size) + 1, np.int64)
    levels = size_levels(int(size.max()), percent)
    level = np.searchsorted(levels, size[docs], side="right") - 1
    owner = np.repeat(np.arange(len(docs)), size[docs])
    values = mixed(sets ^ np.uint64(0x5BD1E9955BD1E995))
    keys, owners = [], []
    for up in (0, 1):
        meet = level + up
        parts, margin = dealing(percent, levels, meet)
        open_ = np.ones(len(docs), bool)
        for seed in range(1, SEEDS + 1):
            own = mixed(meet.astype(np.uint64) + np.uint64(seed << 32))
            take = open_[owner]
            many = np.where(open_, parts, 0)
            base = np.concatenate([[0], np.cumsum(many)])
            who = owner[take]
            place = base[who] + (mixed(sets[take] ^ own[who]) % parts[who].astype(np.uint64)).astype(np.int64)
            full = np.bincount(place, minlength=base[-1]) > 0
            whose = np.repeat(np.arange(len(docs)), many)
            nth = (np.arange(base[-1]) - base[whose]).astype(np.uint64)
            name = mixed(_sums(values[take], place, base[-1]) + mixed((nth << np.uint64(8)) + own[whose]))
            keys.append(name[full])
            owners.append(whose[full])
            open_ &= np.bincount(whose[~full], minlength=len(docs)) > margin
            if not open_.any():
                break
        left = np.flatnonzero(open_)
        keys.append(mixed(meet[left].astype(np.uint64) + np.uint64(255 << 32)))
        owners.append(left)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.searchsorted(docs[owners[order]], np.arange(len(size) + 1))


def fine_parts(sets: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """A finer dealing: set, window, part key, and how many of its rarest parts a set has to show.

    Sets whose difference has at most need - 1 shingles differ in at most so many
    parts. In any common order of the parts, their first need ones then share one.
    """
    size = np.diff(bounds)
    docs = np.flatnonzero(size)
    if not len(docs):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none
    levels = size_levels(int(size.max()), percent)
    level = np.searchsorted(levels, size[docs], side="right") - 1
    owner = np.repeat(np.arange(len(docs)), size[docs])
    values = mixed(sets ^ np.uint64(0xA0761D6478BD642F))
    out = []
    for up in (0, 1):
        meet = level + up
        need = 2 * (100 - percent) * (levels[meet + 1] - 1) // (100 + percent) + 1
        parts = FINER * need
        base = np.concatenate([[0], np.cumsum(parts)])
        seed = mixed(meet.astype(np.uint64) + np.uint64(3 << 32))
        place = base[owner] + (mixed(sets ^ seed[owner]) % parts[owner].astype(np.uint64)).astype(np.int64)
        whose = np.repeat(np.arange(len(docs)), parts)
        nth = (np.arange(base[-1]) - base[whose]).astype(np.uint64)
        key = mixed(_sums(values, place, base[-1]) + mixed((nth << np.uint64(8)) + seed[whose]))
        out.append((docs[whose], meet[whose], key, need[whose]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _finer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                lists = batch.column("shingles")
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                values = np.asarray(lists.flatten(), np.int64).view(np.uint64)
                owner, window, key, need = fine_parts(values, bounds, percent)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(pa.array(owner)),
                        pa.array(window.astype(np.int32)),
                        pa.array(signed(key)),
                        pa.array(need.astype(np.int32)),
                    ],
                    names=["node", "window", "part", "need"],
                )

    return run


def refined(nodes: DataFrame, classes: Classes, percent: int) -> DataFrame:
    """(part, node): regions of unresolved classes, by each one's rarest parts of a finer dealing.

    Copies that differ from a common source by more than the threshold have enough
    parts of their own to meet nobody; those nearer were joined by their pivot.
    """
    fine = written(
        classes.sets(nodes).mapInArrow(_finer(percent), "node long, window int, part long, need int"), "fine"
    )
    often = fine.groupBy("part").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node", "window").orderBy("often", "part")
    rarest = fine.join(often, "part").withColumn("at", F.row_number().over(order))
    return written(rarest.where("at <= need and often > 1").select("part", "node").distinct(), "members")


class Names:
    """64-bit names of sets; of different sets with one name all but one class are given others.

    apart maps (name, second hash) of such classes to their other names; it has as
    many entries as names collide, which is n * n / 2 ** 65 for n classes.
    """

    def __init__(self, apart: dict[tuple[int, int], int] | None = None, bits: int = 64):
        self.apart, self.bits = apart or {}, bits

    def second(self, sets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return mixed(_sums(mixed(sets ^ np.uint64(0x9E3779B97F4A7C15)), owner, n))

    def of(self, sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and second hashes of sets."""
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(size)), size)
        names = signed(mixed(_sums(mixed(sets), owner, len(size)) + size.astype(np.uint64)) >> np.uint64(64 - self.bits))
        second = signed(self.second(sets, owner, len(size)))
        if self.apart:
            for i in np.flatnonzero(np.isin(names, [k for k, _ in self.apart])).tolist():
                names[i] = self.apart.get((int(names[i]), int(second[i])), names[i])
        return names, second


def _profiler(k: int, names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets, bounds = shingle_sets(batch.column("text"), k)
                name, second = names.of(sets, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("key"),
                        pa.array(np.diff(bounds)),
                        pa.array(name),
                        pa.array(second),
                    ],
                    names=["doc_id", "key", "n", "node", "check"],
                )

    return run


def _dealer(k: int, percent: int, names: Names):
    """(part, node) of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                sets, bounds = shingle_sets(batch.column("text"), k)
                keys, at = signatures(sets, bounds, percent)
                node = np.repeat(names.of(sets, bounds)[0], np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(node)], names=["part", "node"])

    return run


SETS = "node long, shingles array<long>"
SKETCH_COLUMNS = ["node", "n", *(f"s{i}" for i in range(SKETCH)), "wide"]
SKETCHES = ", ".join(f"{c} {'binary' if c == 'wide' else 'long'}" for c in SKETCH_COLUMNS)


def parities(sets: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each set 64-bit words of parity bits: two sets differ in no more bits than in shingles.

    The number of words is a power of two that follows the size. Halves laid upon
    each other by xor are the sketch of half as many words.
    """
    size = np.diff(bounds)
    words = np.maximum(SKETCH, (1 << np.ceil(np.log2(np.maximum(WIDE * size, 1))).astype(np.int64)) // 64)
    base = np.concatenate([[0], np.cumsum(64 * words)])
    owner = np.repeat(np.arange(len(size)), size)
    place = mixed(sets ^ np.uint64(0xE7037ED1A0B428DB)) & (64 * words[owner] - 1).astype(np.uint64)
    odd = (np.bincount(base[owner] + place.astype(np.int64), minlength=base[-1]) & 1).astype(np.uint8)
    return np.split(np.packbits(odd, bitorder="little").view("<u8"), base[1:-1] // 64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set that has so many words, a power of two below its own."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def near_enough(a: str, b: str, percent: int):
    """Column: what sizes and sketches of two sets allow; true for every linked pair."""
    at = lambda t, c: F.col(f"{t}.{c}")
    differ = sum((F.bit_count(at(a, f"s{i}").bitwiseXOR(at(b, f"s{i}"))) for i in range(1, SKETCH)), F.bit_count(at(a, "s0").bitwiseXOR(at(b, "s0"))))
    n, m = at(a, "n"), at(b, "n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _setter(k: int, names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets, bounds = shingle_sets(batch.column("text"), k)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(names.of(sets, bounds)[0]), lists], names=["node", "shingles"])

    return run


def _sketcher(k: int, names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets, bounds = shingle_sets(batch.column("text"), k)
                wide = parities(sets, bounds)
                short = np.array([folded(w, SKETCH) for w in wide], "<u8").reshape(-1, SKETCH).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names.of(sets, bounds)[0]),
                        pa.array(np.diff(bounds)),
                        *(pa.array(np.ascontiguousarray(short[:, i])) for i in range(SKETCH)),
                        pa.array([w.tobytes() for w in wide], pa.binary()),
                    ],
                    names=SKETCH_COLUMNS,
                )

    return run


def _open(percent: int):
    """(u, v) of the pairs that sizes and long sketches leave open; all linked ones are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            stays = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
            a, b = batch.column("a"), batch.column("b")
            for i in np.flatnonzero(stays).tolist():
                x, y = (np.frombuffer(c[i].as_buffer(), "<u8") for c in (a, b))
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                stays[i] = differ * (100 + percent) <= (n[i] + m[i]) * (100 - percent)
            yield batch.select(["u", "v"]).filter(pa.array(stays))

    return run


class Classes:
    """The unresolved classes: their sketches, and their sets by need.

    active has the node and the key of one text of each; repeated tells whether
    texts have rows of the same key.
    """

    def __init__(self, docs: DataFrame, active: DataFrame, shingle: int, names: Names, repeated: bool):
        self.docs, self.active, self.shingle, self.names, self.repeated = docs, active, shingle, names, repeated
        made = self._texts(active.select("key")).mapInArrow(_sketcher(shingle, names), SKETCHES)
        self.sketches = written(made.dropDuplicates(["node"]) if repeated else made, "sketches")

    def _texts(self, keys: DataFrame) -> DataFrame:
        rows = _only(self.docs, keys).select("key", "text")
        return (rows.dropDuplicates(["key", "text"]) if self.repeated else rows).select("text")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of some classes, made from their texts."""
        keys = written(self.active.join(nodes, "node", "left_semi").select("key"), "keys")
        return self._texts(keys).mapInArrow(_setter(self.shingle, self.names), SETS)


def verified(pairs: DataFrame, classes: Classes, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are within the threshold; only sets of pairs that sketches leave open are moved."""
    side = lambda node, n, wide: classes.sketches.select(F.col("node").alias(node), F.col("n").alias(n), F.col("wide").alias(wide))
    both = pairs.join(side("v", "m", "b"), "v").join(side("u", "n", "a"), "u").select("u", "v", "n", "m", "a", "b")
    left = written(both.mapInArrow(_open(percent), "u long, v long"), "open")
    nodes = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = written(classes.sets(nodes), "sets")
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (
        left.join(b, "v")
        .join(a, "u")
        .select("u", "v", both.alias("both"), (F.size("a") + F.size("b") - both).alias("all"))
        .where(F.col("both") * 100 >= F.col("all") * percent)
        .select("u", "v")
    )


def _unresolved(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(part, node, root) of regions with more than one component."""
    named = members.withColumn("root", F.col("node"))
    if roots is not None:
        named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("part").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("part")
    return named.join(several, "part")


def link_components(members: DataFrame, classes: Classes, percent: int) -> DataFrame | None:
    """(node, root) of linked classes, from region members (part, node); None if nothing is linked."""
    tested = roots = None
    pivots = 0
    while True:
        swept(members.sparkSession)
        left = written(_unresolved(members, roots), "unresolved")
        if left.isEmpty():
            return roots
        if tested is None:
            # each member meets the pivot that it shares most regions with
            pivot = left.groupBy("part").agg(F.min("node").alias("u"))
            near = left.join(pivot, "part").where("node != u").groupBy("node", "u").count()
            pairs = near.groupBy("node").agg(F.max(F.struct("count", "u")).alias("m")).select("m.u", F.col("node").alias("v"))
        else:
            if not pivots:
                pivots = PIVOTS
                size = left.groupBy("part").count().withColumn("large", F.col("count") > REGION).drop("count")
                large = left.join(size.where("large"), "part", "left_semi")
                if not large.isEmpty():
                    few = left.join(size.where("large"), "part", "left_anti").select("part", "node")
                    members = few.unionByName(refined(large.select("node").distinct(), classes, percent)).distinct()
                    continue
            ranked = left.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("node")))
            ranked = written(ranked.join(classes.sketches.drop("wide"), "node"), "ranked")
            head = ranked.where(F.col("at") <= pivots)
            meets = (F.col("x.part") == F.col("y.part")) & (F.col("x.at") > F.col("y.at")) & (F.col("x.root") != F.col("y.root"))
            pairs = (
                ranked.alias("x")
                .join(head.alias("y"), meets & near_enough("x", "y", percent))
                .select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))
                .distinct()
                .join(tested, ["u", "v"], "left_anti")
            )
            members = ranked.where(F.col("at") > pivots).select("part", "node")
            pivots *= PIVOTS
        pairs = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = written(verified(pairs, classes, percent), "links")
        if new.isEmpty():
            continue
        swept(members.sparkSession)
        # the components so far count as stars, so that new links alone take rounds
        known = [] if roots is None else [roots.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))]
        roots = components(reduce(DataFrame.unionByName, known, new))


def told_apart(profile: DataFrame, names: Names) -> Names:
    """Names that differ wherever the second hashes do."""
    met = profile.where("n > 0").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a != b")
    more = profile.join(met, "node").where("check != a").select("node", "check").distinct()
    other = F.xxhash64("node", "check", F.lit("apart"))
    return Names({(r["node"], r["check"]): r["other"] for r in more.withColumn("other", other).collect()}, names.bits)


def jaccard_components(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """Per document: doc_id, key, n_shingles, component_id (the least doc_id reachable by links), group.

    group names the component whatever its ids are; without shingles it is the key.
    bits is the length of the names that classes have at first; tests make them collide.
    """
    ship(docs.sparkSession)
    docs = keyed(docs)
    names = Names(bits=bits)
    profile = written(docs.mapInArrow(_profiler(shingle, names), PROFILE), "profile")
    names = told_apart(profile, names)
    if names.apart:
        rows = [(*k, v) for k, v in names.apart.items()]
        other = docs.sparkSession.createDataFrame(rows, "node long, check long, other long")
        renamed = profile.join(F.broadcast(other), ["node", "check"], "left").withColumn("node", F.coalesce("other", "node"))
        profile = renamed.select(*profile.columns)
    classes = written(
        profile.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("key").alias("key")), "classes"
    )
    # one text of each class is dealt to parts; a part is shared where its next neighbour is another class
    parts = _only(docs, classes.select("key")).select("text").mapInArrow(_dealer(shingle, percent, names), "part long, node long")
    by_part = Window.partitionBy("part").orderBy("node")
    beside = parts.select("part", "node", F.lag("node").over(by_part).alias("a"), F.lead("node").over(by_part).alias("b"))
    members = written(beside.where("a != node or b != node").select("part", "node").distinct(), "members")
    active = written(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "key"), "active")
    repeated = not profile.groupBy("key").count().where("count > 1").isEmpty()
    roots = link_components(members, Classes(docs, active, shingle, names, repeated), percent)
    named = classes.select("node", "first", F.col("node").alias("root"))
    if roots is not None:
        rooted = classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
        least = rooted.groupBy("root").agg(F.min("first").alias("least"))
        named = rooted.join(least, "root").select("node", F.col("least").alias("first"), "root")
    return profile.join(named, "node", "left").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("root", "key").alias("group"),
    )


def one_of_each(docs: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """docs without all but one document of each component: that of least doc_id, then key."""
    found = written(jaccard_components(docs, shingle=shingle, percent=percent), "components")
    swept(docs.sparkSession)
    stays = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("m"))
    stays = written(stays.select(F.col("m.key").alias("key")), "stays")
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("own"), F.xxhash64(doc, text).alias("key"))
    kept = _only(rows, stays)
    if not found.groupBy("key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return kept.select("own.*")


def op10_jaccard_metric_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles are 90 % alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, shingle=3, percent=90).drop("key", "group")


def brute_force(docs, shingle: int = SHINGLE, percent: int = PERCENT):
    """The contract's columns by comparing all pairs; for tests."""
    sets = []
    for _, text in docs:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if both * 100 >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    for i, (d, _) in enumerate(docs):
        yield d, len(sets[i]), least.get(find(i)) if sets[i] else d
