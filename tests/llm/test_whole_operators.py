"""Training-data operators on tables where a cut would show."""

import random

from termloom.llm import lines, substrings
from termloom.operators import diskindex

DOCS = "doc_id long, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_long_lines_are_runs(spark):
    rng = random.Random(3)
    long = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 50), ("q", 125))]
    short = " ".join(f"s{i}" for i in range(49))
    docs = [(1, long[0]), (2, f"x\n{long[0]}\ny"), (3, long[0]), (4, short), (5, f"z\n{short}"), (6, f"{long[1]}\nu\n{long[1]}")]
    docs += [(i, "\n".join(rng.choice(["a", "b", " ", short, *long]) for _ in range(rng.randint(0, 6)))) for i in range(7, 40)]
    seen, want = set(), []
    for d, text in docs:
        every = text.split("\n")
        at = [i for i, x in enumerate(every) if x.strip()]
        gone = set()
        for k in range(len(at)):
            runs = [at[k : k + 2]] if k + 1 < len(at) else []
            runs += [at[k : k + 1]] if len(every[at[k]].split()) >= 50 else []
            for run in runs:
                key = tuple(every[i] for i in run)
                gone |= set(run) if key in seen else set()
                seen.add(key)
        want.append((d, "\n".join(x for i, x in enumerate(every) if i not in gone)))
    assert dict(want)[2] == "x\ny" and dict(want)[3] == "" and dict(want)[5] == f"z\n{short}"
    assert rows_of(lines.dedup_lines(spark.createDataFrame(docs, DOCS))) == sorted(want, key=repr)


def test_batches_meet_the_history_of_an_index(spark):
    rng = random.Random(7)
    w = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passages = [w(n) for n in (40, 25, 60)]
    parts = []
    for b in range(3):
        # each passage once a batch, between words of its own
        parts.append([(10 * b + i, " ".join(w(30) + p + w(30))) for i, p in enumerate(passages)] + [(10 * b + 9, " ".join(w(50)))])
    parts[2].append(parts[0][0])
    index, before = substrings.FingerprintIndex(spark), []
    for part in parts:
        got = substrings.dedup_substrings(spark.createDataFrame(part, DOCS), window=20, gram=5, index=index)
        before += part
        # counted over all batches so far, told of the rows of the last one
        want = list(substrings.brute_force(before, 20))[-len(part) :]
        assert rows_of(got) == sorted(want, key=repr)


def test_an_index_goes_on_in_another_session(spark, tmp_path):
    rng = random.Random(8)
    w = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passages = [w(n) for n in (40, 25, 60)]
    path, before = f"{tmp_path}/index", []
    for b in range(3):
        part = [(10 * b + i, " ".join(w(30) + p + w(30))) for i, p in enumerate(passages)] + [(10 * b + 9, " ".join(w(50)))]
        if b == 2:
            part += [before[0], (None, None), (29, "")]
        other = spark.newSession()
        index = substrings.FingerprintIndex(other, path)
        assert len(index.history) == b
        got = substrings.dedup_substrings(other.createDataFrame(part, DOCS), window=20, gram=5, index=index)
        before += part
        want = list(substrings.brute_force(before, 20))[-len(part) :]
        assert rows_of(got) == sorted(want, key=repr)
    assert spark.sql("show tables").where("tableName like 'termloom%'").count() == 0
    held = substrings.FingerprintIndex(spark, path).merged().count()
    assert diskindex.vacuum(spark, path)
    assert substrings.FingerprintIndex(spark, path).merged().count() == held
