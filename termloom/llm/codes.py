"""Vector codes by Hamerly's bounds: product quantisation with exact integer Lloyd rounds.

Components become integers, vectors are cut into parts, and each part's codebook is
moved by Lloyd rounds over all vectors. With each vector go, for each of its parts, its
entry, an upper bound of the distance to it and one lower bound of the distance to the
second nearest. When entries move, the upper bound grows by the move of the part's own
entry and the lower one shrinks by the largest move of another. A part keeps its entry
where the upper bound, if need be after its distance is taken anew, is strictly below
the lower bound or half the way to the nearest other entry; else all entries are compared
in integers, where the lower index wins ties. Bounds are rounded away from each other,
so codes are those of comparing everything.

A round is one pass over a table of vectors with their bounds, which is written to the
shared folder with the sums that each task adds to the entries, a row a task; the driver
holds the codebooks alone. The table of the round before goes once the next is written.

Defined cases: rows with a null vector or with null or non-finite components are dropped;
a null or repeated vec_id is kept, nulls last and ties in the order of their components;
fewer rows than entries make smaller codebooks; an empty table gives no rows. Parts have
the same size, the last ones less where the length isn't a multiple. Vectors of another
length than that of the least vec_id can't be compared: they keep a row with null code
and error. Components beyond 2**26 in size after scaling raise ValueError, since sums
might not fit. Extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import scratch_path, ship, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest size of an integer component; squares of whole parts are then far from 2**63.
LARGEST = 1 << 26
#: Rows a task works on at once.
ROWS = 1 << 14
#: Groups of labels up to which their sums are sent to all tasks; beyond, a join shuffles them.
LABELS = 100_000

STATE = "vec_id long, label int, v binary, code binary, upper binary, lower binary, error long, sums binary"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, integer components, of rows that are whole and finite."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    # a power of two times a float is exact as a double
    scaled = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), scaled.alias("v"))


def _cuts(size: int, parts: int) -> list[tuple[int, int]]:
    step = -(-size // parts)
    return [(min(size, k * step), min(size, (k + 1) * step)) for k in range(parts)]


def _away(x: np.ndarray, up: bool) -> np.ndarray:
    """As 32-bit floats, not below (above) x."""
    y = x.astype(np.float32)
    wrong = y < x if up else y > x
    y[wrong] = np.nextafter(y[wrong], np.float32(np.inf if up else -np.inf))
    return y


class Book:
    """The entries of one part: integers, and what moving them means for bounds."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = np.sqrt(_squares(entries, entries).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - 1e-12)
        move = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=1).astype(np.float64))
        self.own = move * (1 + 1e-12)
        rest = np.where(np.eye(len(entries), dtype=bool), 0, self.own[None, :])
        self.other = rest.max(axis=1)  # of any entry but this one


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer squared distances of all rows of x to all of y."""
    return np.stack([((x - e) ** 2).sum(axis=1) for e in y], axis=1) if len(y) else np.zeros((len(x), 0), np.int64)


def _scan(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries, lower index first, their squared distances, and bounds."""
    d = _squares(x, book.entries)
    code = d.argmin(axis=1)
    row = np.arange(len(x))
    best = d[row, code]
    d[row, code] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - 1e-12) if d.shape[1] > 1 else np.full(len(x), np.inf)
    return code, best, np.sqrt(best.astype(np.float64)) * (1 + 1e-12), second


def assigned(x: np.ndarray, book: Book, code: np.ndarray | None, upper: np.ndarray, lower: np.ndarray):
    """Entries, bounds and squared distances (where known, else -1) of a part under a moved book, and how many were scanned."""
    if code is None:
        code, best, upper, lower = _scan(x, book)
        return code, upper, lower, best, len(x)
    code = code.astype(np.int64)
    upper = (upper.astype(np.float64) + book.own[code]) * (1 + 1e-12)
    lower = lower.astype(np.float64) - book.other[code]
    lower = lower - np.abs(lower) * 1e-12
    known = np.full(len(x), -1, np.int64)
    safe = np.maximum(lower, book.half[code])
    loose = np.flatnonzero(upper >= safe)
    known[loose] = ((x[loose] - book.entries[code[loose]]) ** 2).sum(axis=1)
    upper[loose] = np.sqrt(known[loose].astype(np.float64)) * (1 + 1e-12)
    open_ = loose[upper[loose] >= safe[loose]]
    if len(open_):
        code[open_], known[open_], upper[open_], lower[open_] = _scan(x[open_], book)
    return code, upper, lower, known, len(open_)


def _table(column: pa.Array, kind: str, width: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), kind)
    return data.reshape(len(column), width)


def _binaries(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    step = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _round(cuts: list[tuple[int, int]], books: list[Book], first: bool, last: bool):
    """A task's part of a round: rows under the books, and in the end what its rows add to the sums of their entries."""
    size = cuts[-1][1]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in STATE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = len(books[0].entries)
        sums = np.zeros((entries, size + len(cuts)), np.int64)
        scanned = 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                x = _table(batch.column("v"), "<i4", size).astype(np.int64)
                code = None if first else _table(batch.column("code"), "u1", len(cuts))
                upper, lower = (None, None) if first else (_table(batch.column(c), "<f4", len(cuts)) for c in ("upper", "lower"))
                codes, ups, lows = np.zeros((n, len(cuts)), np.uint8), np.zeros((n, len(cuts)), np.float32), np.zeros((n, len(cuts)), np.float32)
                error = np.zeros(n, np.int64)
                for p, ((a, b), book) in enumerate(zip(cuts, books, strict=True)):
                    own = x[:, a:b]
                    c, u, low, known, k = assigned(
                        own, book, None if first else code[:, p], None if first else upper[:, p], None if first else lower[:, p]
                    )
                    scanned += k
                    codes[:, p], ups[:, p], lows[:, p] = c, _away(u, True), _away(low, False)
                    if last:
                        error += np.where(known < 0, ((own - book.entries[c]) ** 2).sum(axis=1), known)
                    else:
                        order = np.argsort(c, kind="stable")
                        some, begin = np.unique(c[order], return_index=True)
                        sums[some, a:b] += np.add.reduceat(own[order], begin, axis=0) if b > a else 0
                        sums[:, size + p] += np.bincount(c, minlength=entries)
                columns = {
                    "vec_id": batch.column("vec_id"),
                    "label": batch.column("label"),
                    "error": pa.array(error) if last else pa.nulls(n, pa.int64()),
                    "v": pa.nulls(n, pa.binary()) if last else batch.column("v"),
                    "code": _binaries(codes),
                    "upper": pa.nulls(n, pa.binary()) if last else _binaries(ups),
                    "lower": pa.nulls(n, pa.binary()) if last else _binaries(lows),
                    "sums": pa.nulls(n, pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)
        if not last:
            told = {"sums": pa.array([sums.astype("<i8").tobytes()], pa.binary()), "error": pa.array([scanned], pa.int64())}
            yield pa.RecordBatch.from_arrays([told.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

    return run


def _total(entries: int, width: int):
    """Adds the sums of tasks, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scanned = np.zeros((entries, width), np.int64), 0
        for batch in batches:
            for row, n in zip(batch.column("sums").to_pylist(), batch.column("error").to_pylist(), strict=True):
                sums += np.frombuffer(row, "<i8").reshape(entries, width)
                scanned += n
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([scanned], pa.int64())], names=["sums", "error"])

    return run


def _gone(spark, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            if len(v) and max(int(v.max()), -int(v.min())) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} in size after scaling")
            rows = _binaries(v.astype("<i4").reshape(batch.num_rows, size))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), rows], names=["vec_id", "label", "v"])

    return run


def vector_codes(
    vectors: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """(vec_id, label, code binary, error) of all whole vectors, the codebooks, and how many parts each round scanned whole."""
    spark = ship(vectors.sparkSession)
    rows = integers(vectors, scale)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.col("v")).limit(entries).collect()  # as many rows as entries
    out = "vec_id long, label int, code binary, error long"
    if not seeds:
        return spark.createDataFrame([], out), [np.zeros((0, 0), np.int64)] * parts, []
    size = len(seeds[0]["v"])
    seeds = [r["v"] for r in seeds if len(r["v"]) == size]
    if any(abs(x) > LARGEST for r in seeds for x in r):
        raise ValueError(f"a component is beyond {LARGEST} in size after scaling")
    cuts = _cuts(size, parts)
    start = np.asarray(seeds, np.int64).reshape(len(seeds), size)
    books = [Book(start[:, a:b]) for a, b in cuts]
    table = rows.where(F.size("v") == size).mapInArrow(_packed(size), "vec_id long, label int, v binary")
    at, scans = None, []
    for k in range(rounds):
        path = scratch_path(spark, f"codes-{k}")
        state = written(table.mapInArrow(_round(cuts, books, k == 0, False), STATE), "codes", path)
        width = size + parts
        told = state.where("sums is not null").select("sums", "error")
        told = told.mapInArrow(_total(len(seeds), width), "sums binary, error long").collect()  # a row a task of the scan
        sums = sum(np.frombuffer(r["sums"], "<i8").reshape(len(seeds), width) for r in told)
        scans.append(sum(r["error"] for r in told))
        moved = []
        for p, ((a, b), book) in enumerate(zip(cuts, books, strict=True)):
            many = sums[:, size + p][:, None]
            moved.append(Book(np.where(many > 0, sums[:, a:b] // np.maximum(many, 1), book.entries), book.entries))
        books = moved
        if at is not None:
            _gone(spark, at)
        at = path
        table = state.where("sums is null").select("vec_id", "label", "v", "code", "upper", "lower")
    coded = table.mapInArrow(_round(cuts, books, rounds == 0, True), STATE).select("vec_id", "label", "code", "error")
    coded = written(coded, "coded")
    if at is not None:
        _gone(spark, at)
    other = rows.where(F.size("v") != size).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), [b.entries for b in books], scans


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of all rows of a label together, nulls being one label."""
    key = [F.coalesce(F.col("label"), F.lit(0)).alias("_label"), F.col("label").isNull().alias("_null")]
    sums = written(coded.groupBy(*key).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= LABELS:
        sums = F.broadcast(sums)
    return coded.select("*", *key).join(sums, ["_label", "_null"], "left").drop("_label", "_null")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 8 parts, 16 entries each, 6 rounds."""
    coded, books, _ = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(coded).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"),
    )


def op11_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by comparing every part with every entry in every round; parts must divide the vectors."""
    steps = [
        f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), part AS (
  SELECT r, (i - 1) * {parts} // len(x) AS p, i, floor({scale} * x[i]::DOUBLE)::BIGINT AS c
  FROM (SELECT r, x, unnest(range(1, len(x) + 1)) AS i FROM kept)
), book0 AS (
  SELECT p, r - 1 AS e, i, c FROM part WHERE r <= {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""far{k} AS (
  SELECT r, part.p, e, sum((part.c - b.c) * (part.c - b.c))::BIGINT AS d
  FROM part JOIN book{k} b USING (p, i) GROUP BY r, part.p, e
), near{k} AS (
  SELECT r, p, e, d FROM far{k} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1
)""")
        if k < rounds:
            steps.append(f"""sums{k} AS (
  SELECT p, e, i, sum(c)::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{k} JOIN part USING (r, p) GROUP BY p, e, i
), book{k + 1} AS (
  SELECT b.p, b.e, b.i, CASE WHEN n > 0 THEN ((s - ((s % n) + n) % n) // n)::BIGINT ELSE b.c END AS c
  FROM book{k} b LEFT JOIN sums{k} USING (p, e, i)
)""")
    return (
        ",\n".join(steps).lstrip()
        + f""", coded AS (
  SELECT r, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
    )
