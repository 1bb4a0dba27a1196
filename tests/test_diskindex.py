"""The index on disk, and readers, writers and learners that no query runs, against plain Python."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termloom.operators import candidates, diskindex, index, learn
from termloom.operators import search as se
from termloom.sources import sinks
from termloom.sources import tables as src


def plain(texts):
    p = Counter((d, t) for d, x in texts.items() for t in x.split())
    dl = Counter(d for d, x in texts.items() for _ in x.split())
    return {
        "postings": sorted(("unigram", d, t, n, dl[d]) for (d, t), n in p.items()),
        "terms": sorted(("unigram", t, sum(u == t for _, u in p), sum(n for (_, u), n in p.items() if u == t)) for t in {t for _, t in p}),
        "lengths": sorted(("unigram", d, n, sum(e == d for e, _ in p)) for d, n in dl.items()),
    }


def told(tables):
    return {k: sorted(tuple(r) for r in df.collect()) for k, df in tables.items()}


def postings(spark, texts):
    return index.postings(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))


def test_index_is_opened_by_path_in_another_session(spark, tmp_path):
    rng = random.Random(1)
    texts = {d: " ".join(rng.choice(["a", "b", "c", f"t{d}"]) for _ in range(rng.randint(1, 9))) for d in range(30)}
    path, other = str(tmp_path / "ix"), spark.newSession()
    with pytest.raises(FileNotFoundError):
        diskindex.open_index(other, path)
    some = lambda k: {d: x for d, x in texts.items() if d % 3 == k}
    diskindex.create(postings(spark, some(0)), path)
    before = diskindex.open_index(other, path)
    first = told(before)
    assert first == plain(some(0))
    diskindex.append(postings(other, some(1)), path)
    diskindex.append(postings(spark, some(2)), path)
    assert told(diskindex.open_index(other, path)) == plain(texts)
    assert len(diskindex.manifest(spark, path)["runs"]) == 3
    assert told(before) == first  # what was opened before stays as it was
    changed = {3: "new words", 100: "a b"}
    diskindex.append(postings(spark, changed), path)
    assert told(diskindex.open_index(other, path)) == plain(texts | changed)
    diskindex.compact(spark, path)
    assert len(diskindex.manifest(spark, path)["runs"]) == 1
    assert diskindex.vacuum(spark, path) and diskindex.vacuum(spark, path) == []
    assert told(diskindex.open_index(other, path)) == plain(texts | changed)
    assert [r[0] for r in spark.sql("show tables").collect()] == []
    q = spark.createDataFrame([(1, 0, "new", 1.0, "should")], "query_id long, clause int, term string, boost double, occur string")
    assert [r["doc_id"] for r in se.Index.stored(diskindex.open_index(other, path)).search(q).collect()] == [3]


def test_one_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path / "ix")
    diskindex.create(postings(spark, {1: "a"}), path)
    known = diskindex.manifest(spark, path)
    diskindex.commit(spark, path, known | {"version": known["version"] + 1})
    with pytest.raises(RuntimeError, match="another writer"):
        diskindex.commit(spark, path, known | {"version": known["version"] + 1, "runs": []})
    assert diskindex.manifest(spark, path)["runs"] == known["runs"]


def test_runs_are_merged_and_empty_ones_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(diskindex, "FANOUT", 2)
    path = str(tmp_path / "ix")
    diskindex.append(postings(spark, {}), path)
    assert told(diskindex.open_index(spark, path)) == {"postings": [], "terms": [], "lengths": []}
    for d in range(3):
        diskindex.append(postings(spark, {d: f"x y{d}"}), path)
    assert len(diskindex.manifest(spark, path)["runs"]) <= 2
    assert told(diskindex.open_index(spark, path)) == plain({d: f"x y{d}" for d in range(3)})


def test_a_heavy_term_has_many_files(spark, tmp_path):
    p = spark.range(60_000).select(F.lit("unigram").alias("field"), F.col("id").alias("doc_id"), F.lit("the").alias("term"), F.lit(1).cast("long").alias("tf"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = diskindex.create(p, str(tmp_path / "ix"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in t["postings"].groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 30_000 and sum(sizes) == 60_000


# -- readers and writers -----------------------------------------------------------


def test_readers_of_text_files(spark, tmp_path):
    (tmp_path / "clicks.tsv").write_text("a\tb\tlink\t7\nc\td\tlink\t1\n")
    assert [tuple(r) for r in src.read_clicks(spark, f"{tmp_path}/clicks.tsv").collect()] == [("a", "b", 7), ("c", "d", 1)]
    (tmp_path / "ids.tsv").write_text("e1\tNew York\ne2\tx\n")
    assert [tuple(r) for r in src.read_entity_map(spark, f"{tmp_path}/ids.tsv").collect()] == [("e1", "New_York"), ("e2", "x")]
    (tmp_path / "shared.tsv").write_text("q\t1.0 2.5\t-1\t\n")
    assert [tuple(r)[:3] for r in src.read_shared_features(spark, f"{tmp_path}/shared.tsv").collect()] == [("q", [1.0, 2.5], [-1.0])]
    for topic, name, text in (("t1", "a", "one\ntwo"), ("t1", "b", "three"), ("t2", "a", "")):
        (tmp_path / "topics" / topic).mkdir(parents=True, exist_ok=True)
        (tmp_path / "topics" / topic / name).write_text(text)
    got = sorted((r["topic"], r["text"]) for r in src.read_topics(spark, f"{tmp_path}/topics").collect())
    assert [x for x in got if x[1]] == [("t1", "one\ntwo"), ("t1", "three")]


def test_weights_subsets_and_logs(spark, tmp_path):
    sinks.write_lines(sinks.weight_lines(spark, [0.5, -1e-7, 3.0], "a model\nof three"), f"{tmp_path}/model")
    assert src.read_weights(spark, f"{tmp_path}/model") == [0.5, -1e-7, 3.0]
    sinks.write_lines(sinks.subset_lines(spark, [4, 2]), f"{tmp_path}/subset")
    assert sorted(int(r[0]) for r in spark.read.text(f"{tmp_path}/subset").collect()) == [2, 4]
    (tmp_path / "log").write_text("Fold 1\nMAP on training data: 0.4\nMAP on test data: 0.2\nx\nMAP on training data: 0.6\nMAP on test data: 0.5\n")
    got = [tuple(r) for r in src.read_log(spark, f"{tmp_path}/log").orderBy("fold").collect()]
    assert got == [(1, 0.4, 0.2, pytest.approx(0.3)), (2, 0.6, 0.5, pytest.approx(0.55))]
    rows = spark.createDataFrame([("p1", "a\tb\nc", ["x", "y"]), (None, None, None)], "id string, t string, l array<string>")
    assert [r[0] for r in sinks.extraction_rows(rows).collect()] == ["p1\ta b c\tx y", "\t\t"]


def test_one_row_of_each_name_is_picked_by_its_seed(spark):
    rows = [(q, n, i) for q in "ab" for n in "xy" for i in range(4)]
    df = spark.createDataFrame(rows, "query string, name string, id long")
    picks = [sorted(tuple(r) for r in sinks.one_per_name(df.repartition(k + 1), seed).collect()) for k, seed in enumerate((1, 1, 2, 3, 4))]
    assert picks[0] == picks[1] and len({tuple(p) for p in picks}) > 1
    assert all({(q, n) for q, n, _ in p} == {(q, n) for q in "ab" for n in "xy"} and len(p) == 4 for p in picks)


def test_a_pool_is_given_to_each_query_of_its_page(spark):
    pool = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0), (2, 10, 3.0)], "page long, doc_id long, score double")
    queries = spark.createDataFrame([(1, "1/a"), (1, "1/b"), (3, "3/a")], "page long, query_id string")
    got = sorted((r["query_id"], r["doc_id"], r["score"]) for r in candidates.fan_out(pool, queries).collect())
    assert got == [("1/a", 10, 2.0), ("1/a", 11, 1.0), ("1/b", 10, 2.0), ("1/b", 11, 1.0)]


# -- learners ----------------------------------------------------------------------


def plain_map(rows, w):
    out = []
    for q in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-round(sum(x * y for x, y in zip(r[3], w)), 9), r[1]))
        hits = [k for k, r in enumerate(own, 1) if r[2]]
        out.append(sum((j + 1) / k for j, k in enumerate(hits)) / len(hits) if hits else 0.0)
    return sum(out) / len(out)


@pytest.fixture(scope="module")
def ranked(spark):
    rng = random.Random(5)
    rows = [(q, i, int(rng.random() < 0.3), [rng.random(), rng.random(), rng.random()]) for q in range(6) for i in range(8)]
    return rows, spark.createDataFrame(rows, "qid long, id long, rel int, features array<double>").cache()


def test_sweep_takes_the_best_move(ranked):
    rows, df = ranked
    w, best = learn.sweep(lambda t: learn.evaluate_map(df, t), [1.0, 1.0, 1.0])
    trials = [[1.0] * 3] + [[1.0 + s * 0.15 * (i == k) for i in range(3)] for k in range(3) for s in (1, -1)]
    values = [plain_map(rows, t) for t in trials]
    assert best == pytest.approx(max(values)) and plain_map(rows, w) == pytest.approx(max(values))


def test_alternating_climbs(ranked):
    f = lambda a, b: -((a[0] - 0.4) ** 2) - (b[0] - 1.3) ** 2 - (b[1] + 0.2) ** 2 - 0.1 * a[0] * b[0]
    a, b, curve = learn.alternating(lambda t, b: [f(x, b) for x in t], lambda t, a: [f(a, x) for x in t], [1.0], [1.0, 1.0], rounds=4, inner=4)
    assert curve == sorted(curve) and curve[-1] == pytest.approx(f(a, b)) and curve[-1] > f([1.0], [1.0, 1.0])


def test_cross_validation_reports_its_own_folds(ranked):
    rows, df = ranked
    folds = learn.coordinate_ascent(df, 3, rounds=1, folds=2)
    of = {r["qid"]: r["f"] for r in df.select("qid", F.pmod(F.xxhash64("qid"), F.lit(2)).alias("f")).distinct().collect()}
    for got in folds:
        train, test = ([r for r in rows if (of[r[0]] == got["fold"]) == held] for held in (False, True))
        assert got["train"] == pytest.approx(plain_map(train, got["weights"]) if train else 0.0)
        assert got["test"] == pytest.approx(plain_map(test, got["weights"]) if test else 0.0)


def test_pairs_and_reweighting(ranked):
    import math

    rows, df = ranked
    assert [(i, round(x, 9)) for i, x in learn.alpha_pairs(df, 3)] == [(i, round(plain_map(rows, [1.0 if k in (0, i) else 0.0 for k in range(3)]), 9)) for i in (1, 2)]
    _, history = learn.reweighted(df, rounds=2)
    own = [plain_map(rows, [1.0 if k == i else 0.0 for k in range(3)]) for i in range(3)]
    e = [math.exp(x - max(own)) for x in own]
    assert history[0] == pytest.approx([x / sum(e) * 3 for x in e])


def test_manifest_is_plain_json(spark, tmp_path):
    path = str(tmp_path / "ix")
    diskindex.create(postings(spark, {1: "a"}), path)
    (found,) = (tmp_path / "ix").glob("manifest-*.json")
    assert set(json.loads(found.read_text())) == {"version", "key", "kind", "runs"}
