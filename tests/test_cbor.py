"""The CBOR source: its encoding, a round trip, and tasks that begin at records."""

import io
import random

import pytest
from pyspark.sql import functions as F

from termloom.session import ship
from termloom.sources import cbor


def value(rng, depth=0):
    kind = rng.randint(0, 8 if depth < 3 else 5)
    return [
        lambda: None, lambda: rng.random() < 0.5, lambda: rng.choice([0, 23, 24, 255, 256, 65536, 2**32, 2**63, -1, -25, -(2**40)]), lambda: rng.random(),
        lambda: rng.randbytes(rng.randint(0, 300)), lambda: "é日x" * rng.randint(0, 100), lambda: [value(rng, depth + 1) for _ in range(rng.randint(0, 30))],
        lambda: {str(k): value(rng, depth + 1) for k in range(rng.randint(0, 30))}, lambda: [],
    ][kind]()


def test_values_come_back(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(cbor, "PIECE", 7)
    some = [value(rng) for _ in range(300)]
    source = cbor.Input(io.BytesIO(b"".join(map(cbor.encode, some))), 0)
    assert [cbor.decode(source) for _ in some] == some and source.done()
    open_ended = bytes.fromhex("9f018202039f0405ffff") + bytes.fromhex("bf61610161629f0203ffff") + bytes.fromhex("7f657374726561646d696e67ff") + bytes.fromhex("c11a514b67b0f93c00")
    source = cbor.Input(io.BytesIO(open_ended), 0)
    assert [cbor.decode(source) for _ in range(5)] == [[1, [2, 3], [4, 5]], {"a": 1, "b": [2, 3]}, "streaming", 1363896240, 1.0]
    with pytest.raises(EOFError):
        cbor.decode(cbor.Input(io.BytesIO(b"\x65ab"), 0))


def test_pages_make_a_round_trip(spark, tmp_path):
    ship(spark)
    spark.dataSource.register(cbor.Pages)
    rng = random.Random(2)

    def sections(path, depth):
        out = []
        for k in range(rng.randint(0, 3)):
            own = [*path, f"h{k}"]
            out.append((own, f"s{k}", [(f"p{j}", "text é " * rng.randint(0, 900), ["A", "B"][:j]) for j in range(rng.randint(0, 2))]))
            if depth < 3:
                out += sections(own, depth + 1)
        return out

    rows = [(f"id{i}", f"name {i}", {"redirects": [f"r{i}"], "categories": []}, sections([], 0)) for i in range(120)] + [(None, "empty", {}, [])]
    df = spark.createDataFrame(rows, cbor.SCHEMA).repartition(3)
    path = str(tmp_path / "pages")
    df.write.format("pages_cbor").mode("append").save(path)
    back = spark.read.format("pages_cbor").option("split", 200_000).load(path)
    plain = lambda d: sorted((r[0] for r in d.select(F.to_json(F.struct("*"))).collect()))
    assert plain(back) == plain(df)
    parts = cbor.Reader(path, 200_000).partitions()
    size = sum(f.stat().st_size for f in (tmp_path / "pages").glob("*.cbor"))
    assert len(parts) >= max(3, size // 2_000_000) and sum(p.stop - p.start for p in parts) == size
    for f in (tmp_path / "pages").glob("*.index"):
        f.unlink()
    assert plain(spark.read.format("pages_cbor").load(path)) == plain(df)  # a file a task
    df.limit(2).write.format("pages_cbor").mode("overwrite").save(path)
    assert spark.read.format("pages_cbor").load(path).count() == 2
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("pages_cbor").load(path + "-absent").count()
