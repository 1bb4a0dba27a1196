"""Training-data operators against brute force, round trips, held-out accuracy and odd tables."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import chat, decontaminate, extract, graphs, jaccard, langid, lines, packing, rules, substrings, toxicity

SF = "/root/testdata/sf0.001"


def rows_of(df, key=repr):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, ties, clashing extra columns."""
    rows = [
        (1, "a b c d e f g h i j k l", "en"), (1, "a b c d e f g h i j k l", "en"), (2, None, None), (3, "", "de"),
        (4, " \n\t ", "en"), (None, "null id text here", None), (5, "x y z " * 4000, "en"), (6, "Ünïcode wörds über alles   end", "de"),
        (7, "<[\\b</s>]> 1 2 3", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("score", "key", "row", "n", "node", "own", "found", "group", "h", "y", "words"):
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def docs_of(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# 1 ----------------------------------------------------------------------------


def test_marginals_are_exact_at_any_length():
    rng = np.random.default_rng(1)
    a, sizes = rng.normal(size=(3, 3)), [0, 5, 1, 13, 0, 8]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    s = rng.normal(size=(starts[-1], 3)) * 2
    got = langid.marginals(s, starts, a, segment=4)
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        x = s[lo:hi]
        if len(x):
            al, be = [np.exp(x[0])], [np.ones(3)]
            for i in range(1, len(x)):
                al.append((al[-1] @ np.exp(a)) * np.exp(x[i]))
            for i in range(len(x) - 1, 0, -1):
                be.insert(0, np.exp(a) @ (np.exp(x[i]) * be[0]))
            m = np.array(al) * np.array(be)
            assert np.allclose(m / m.sum(1, keepdims=True), got[lo:hi], atol=1e-6)


def test_transition_gradient_is_that_of_the_likelihood():
    """Expected pairs equal finite differences of the log partition function."""
    rng = np.random.default_rng(2)
    sizes = [0, 6, 1, 9, 3]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    s, t = rng.normal(size=(starts[-1], 3)), rng.normal(size=(3, 3))

    def log_partition(t):
        total = 0.0
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi > lo:
                a = np.exp(s[lo])
                for i in range(lo + 1, hi):
                    a = (a @ np.exp(t)) * np.exp(s[i])
                total += np.log(a.sum())
        return total

    post, pairs = langid.expected_pairs(s, starts, t, segment=4)
    assert np.allclose(post.sum(1), 1)
    for i in range(3):
        for j in range(3):
            e = np.zeros((3, 3))
            e[i, j] = 1e-5
            assert abs((log_partition(t + e) - log_partition(t - e)) / 2e-5 - pairs[i, j]) < 1e-4


def test_language_query_by_brute_force(spark):
    """Posteriors of the query's own model, recomputed text by text with plain recursions."""
    docs = docs_of(spark)
    model = langid.train(docs.where(~langid.held_out()).where("doc_id is not null").select("doc_id", "text", "lang"))
    told = {r["doc_id"]: r for r in langid.op1_crf_language_id(spark, SF).collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        words = pa.array((text or "").replace("\x00", " ").split() if (text or "").isascii() else [], pa.string())
        if not len(words) or len(words) > 300 or any(ord(c) < 32 and c not in "\t\n\v\f\r" for c in text):
            continue
        e, letters = langid.emissions(words, model.weights)
        x, m = np.exp(e.astype(float)), np.exp(model.transitions)
        al, be = [x[0] / x[0].sum()], [np.ones(x.shape[1])]
        for i in range(1, len(x)):
            al.append((al[-1] @ m) * x[i])
            al[-1] /= al[-1].sum()
        for i in range(len(x) - 1, 0, -1):
            be.insert(0, m @ (x[i] * be[0]))
            be[0] /= be[0].sum()
        p = np.array(al) * np.array(be)
        p = (p / p.sum(1, keepdims=True))[letters]
        if len(p):
            mean = p.mean(axis=0)
            assert told[doc]["lang_pred"] == model.languages[mean.argmax()] and abs(told[doc]["score"] - mean.max()) < 1e-5


def test_language_id(spark, odd, nothing):
    docs = docs_of(spark)
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    strange = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert strange[2]["lang_pred"] == strange[3]["lang_pred"] == strange[4]["lang_pred"] == "und" and strange[2]["score"] == 0
    assert strange[7]["lang_pred"] != "" and len(langid.identified(odd, model).select("own.*").columns) == len(odd.columns)
    assert langid.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(nothing)).collect()} == {"und"}
    en, fr = (docs.where(F.col("lang") == x).where("length(text) > 900").first()["text"].split()[:60] for x in ("en", "fr"))
    both = spark.createDataFrame([(1, " ".join(en + fr))], "doc_id long, text string")
    spans = langid.label_spans(both, model).orderBy("first_word").collect()
    labels = [s["lang"] for s in spans for _ in range(s["first_word"], s["end_word"])]
    assert len(labels) == 120 and sum(x == ("en" if i < 60 else "fr") for i, x in enumerate(labels)) > 100


# 2 ----------------------------------------------------------------------------


def test_line_dedup_by_sql(spark):
    from oracle import compare, connect

    assert compare(spark, connect(SF), lines.op2_winnow_line_dedup, lines.OP2_SQL, SF) == ""


def test_line_dedup_odd(spark, odd, nothing):
    got = lines.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert lines.dedup_lines(nothing).count() == 0
    t = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\n\nb\nx"), (2, "a\n\nb\nx"), (3, "a\nx\na\nb")], "doc_id long, text string")
    assert rows_of(lines.dedup_lines(t)) == [(1, "a\nb\nc"), (2, ""), (2, "\nx"), (3, "a\nx")]
    assert lines.dedup_lines(t, drop_emptied=True).count() == 3


def test_line_dedup_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9)))) for i in range(40)]
    seen, want = set(), []
    for run in (2, 3):
        seen, want = set(), []
        for d, text in docs:
            all_lines = text.split("\n")
            at = [i for i, x in enumerate(all_lines) if x.strip()]
            gone = set()
            for k in range(len(at) - run + 1):
                key = tuple(all_lines[i] for i in at[k : k + run])
                gone |= set(at[k : k + run]) if key in seen else set()
                seen.add(key)
            want.append((d, "\n".join(x for i, x in enumerate(all_lines) if i not in gone)))
        assert rows_of(lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), run=run)) == sorted(want, key=repr)


# 3 ----------------------------------------------------------------------------


def check_packing(rows, capacity):
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(placed)


def test_bin_completion():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 30, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 50)))
        sizes = []
        for f in (packing.best_fit, packing.bin_completion):
            got = Counter()
            for filling, n in f(counts, capacity):
                assert sum(filling) <= capacity
                for x in filling:
                    got[x] += n
            assert got == counts
            sizes.append(sum(n for _, n in f(counts, capacity)))
        assert packing.needed(counts, capacity) <= sizes[1] <= sizes[0]
    # best fit decreasing needs 3 bins here, two are enough
    assert sum(n for _, n in packing.bin_completion({5: 1, 4: 2, 3: 1, 2: 2}, 10)) == 2


def test_tokens_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", "a  b\n\n c", "é 123abc \t x ", "it's 'd  x", " lead", "<|endoftext|> x", "a<|endoftext|>b <|endoftext|>", "Ab.\nCd, e;   f g", "word " * 50]
    rng = random.Random(1)
    signs = [" ", "  ", "a", "'s", "1", "é", "×", "\n", "\x1c", "\u180e", "\u200b", "\ufeff", "\u3000", "\x85", ".", "!", "<|endoftext|>", "中", "\t"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for _ in range(2):  # the second time from the cache
        got = packing.tokens_of(packing.tokenizer_path()).ids(pa.array(texts))
        for ids, e in zip(got, t.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.ids


def test_packed_pieces_of_all_documents(spark):
    """start, length and ids_crc32 of every piece, by the library alone."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for doc, text in docs_of(spark).select("doc_id", "text").collect():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((doc, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())))
    got = packing.op3_bin_completion_packing(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows_of(got) == sorted(want, key=repr)


def test_packing(spark, odd, nothing):
    out = packing.op3_bin_completion_packing(spark, SF).collect()
    used = check_packing(out, 2048)
    assert used <= 1 + -(-sum(r["length"] for r in out) // 2048)
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs_of(spark).select("doc_id").collect()}
    strange = packing.pack_documents(odd, packing.tokenizer_path(), 64).collect()
    check_packing(strange, 64)
    by = defaultdict(list)
    for r in strange:
        by[r["doc_id"]].append(r)
    assert [r["length"] for r in by[2]] == [1] and len(by[1]) == 2
    long = sorted(by[5], key=lambda r: r["piece"])
    assert all(r["length"] == 64 for r in long[1:]) and [r["start"] for r in long[1:]] == [long[0]["length"] + 64 * k for k in range(len(long) - 1)]
    assert packing.pack_documents(nothing, packing.tokenizer_path()).count() == 0


# 4 ----------------------------------------------------------------------------

PAGE = """<html><body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use cookies</div><main>
<article class="post"><h1>T &amp; x</h1><p>{}<b>bold</b>,<br>two&nbsp;three</p><div class="share">Share</div><form>name</form>
<div class=box>Same on every page</div><ul><li>a<li>b</ul><p>Un<p>closed<script>if (a<b) "</p>"</script> end</article>
<div id="comments"><p>I hate</p></div></main><aside>side</aside><footer>f</footer></body></html>"""


def test_extraction(spark, nothing):
    pages = [PAGE.format(x) for x in ("One ", "Two ", "Three ", "Four ")]
    assert extract.extract(pages[0]) == "T & x One bold, two three Same on every page a b Un closed end"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)] + [(9, None, None), (9, "x", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.extract_pages(df.withColumn("host", F.lit("clash"))).collect()}
    assert got[1] == "T & x Two bold, two three Un closed end" and got[9] == ""
    assert extract.extract_pages(df.limit(0)).count() == 0
    assert extract.extract("<p>a<b>c") == "ac" and extract.extract("<<>") in ("<<>", "<", "< <>")
    n, pairs = extract.match(extract.shape_of(extract.parse("<div><p>a</p><ul></ul></div>")), extract.shape_of(extract.parse("<div><ul></ul></div>")))
    assert n == 3 and len(pairs) == 3


def test_extraction_of_generated_pages(spark):
    import html
    import re

    source = {r["page_id"]: r["html"] for r in docs_of(spark, "pages").collect()}
    for r in extract.op4_wrapper_induction(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        parts = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"<h1>|</h1>|</?p>", "\x00", inner))).split("\x00")
        assert r["text"] == " ".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert r["n_chars"] == len(r["text"])


def test_names_and_depth():
    assert extract.extract('<div class="post share-enabled"><p>Article text here</p></div>') == "Article text here"
    assert extract.extract('<main><div class="related-content"><p>Body</p></div></main>') == "Body"
    assert extract.extract('<main><div class="related-posts">x</div><p>Body</p><div id="comments_1">y</div></main>') == "Body"
    deep = "<div>" * 20_000 + "<p>far down</p>" + "</div>" * 20_000
    wrapper = json.dumps(extract.induce([deep, deep.replace("far", "very far"), deep.replace("far", "not far")]))
    assert extract.extract(deep, wrapper) == extract.extract(deep) == "far down"


def test_the_wrapper_alone_decides(spark):
    """Neither tags nor names tell anything; the same text on all pages is template, two layouts have a wrapper each."""
    one = "<div><div>Home News Shop</div><div><div>{0} first words of a long story {0}</div><div>Read our rules</div><div>and {0} more of it, to the end</div></div><div>Made by us</div></div>"
    two = "<table><tr><td>Home News Shop</td><td><div>{0} another kind of page altogether {0} with its own text</div></td></tr></table><div>Made by us</div>"
    rows = [(k, f"http://h/{k}", (one if k % 2 else two).format(f"w{k}")) for k in range(14)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.extract_pages(df).collect()}
    for k in range(14):
        assert "Home News" not in got[k] and "Made by us" not in got[k]
        assert f"w{k}" in got[k] and ("of a long story" in got[k]) == bool(k % 2)
    assert extract.extract(rows[1][2]) != got[1]


def test_wrappers_come_from_every_page(spark):
    """Three of 400 pages of a host have another layout, and one shows another line at a place that is alike on all others."""
    one = "<div><div>Home News Shop</div><div><div>{0} first words of a long story {0}</div><div>{1}</div><div>and {0} more of it, to the end</div></div><div>Made by us</div></div>"
    two = "<table><tr><td>Home News Shop</td><td><div>{0} another kind of page altogether {0} with its own text</div></td></tr></table><div>Made by us</div>"
    rows = [(k, f"http://h/{k}", (two if k % 133 == 5 else one).format(f"w{k}", "This one was withdrawn" if k == 77 else "All rights kept")) for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.extract_pages(df.repartition(7)).collect()}
    assert [got[k] for k in (5, 138, 271)] == [f"w{k} another kind of page altogether w{k} with its own text" for k in (5, 138, 271)]
    assert got[77] == "w77 first words of a long story w77 This one was withdrawn and w77 more of it, to the end"
    assert got[78] == "w78 first words of a long story w78 All rights kept and w78 more of it, to the end"
    made = extract.wrappers(df.select(F.lit("h").alias("host"), "html")).collect()
    assert [r["wrapper"] for r in made] == [json.dumps(extract.induce([r[2] for r in rows]))]


# 5 ----------------------------------------------------------------------------


def test_toxicity(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op5_counterfactual_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and held[held.toxic == 0].predicted.mean() < 0.02 and held[held.toxic == 1].predicted.mean() > 0.6
    model = toxicity.train(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r["score"], 6) for r in toxicity.score(odd, model).collect()} == {0.5}
    assert toxicity.score(nothing, model).count() == 0


def test_counterfactual_penalty():
    """Mentions of a group that go with the label by chance lose their weight, insults keep it."""
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        bad = i % 2
        words = [rng.choice(["red", "green", "blue", "house", "tree", "water"]) for _ in range(20)]
        words += ["scum"] * 2 if bad and rng.random() < 0.9 else []
        words += ["muslim"] if rng.random() < (0.6 if bad else 0.05) else []
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(bad)
    one = toxicity.text_rates(pa.array(texts))
    found = Counter()
    for y, (f, _) in zip(labels, one, strict=True):
        found.update((int(x), y) for x in f)
    counts = [(f, found[f, 0], found[f, 1]) for f in sorted({f for f, _ in found}) if found[f, 0] + found[f, 1] >= 3]
    chosen = toxicity.choose(counts, labels.count(0), labels.count(1))
    place = {int(f): k for k, f in enumerate(chosen)}

    def only(r):
        keep = [i for i, f in enumerate(r[0]) if int(f) in place]
        return np.array([place[int(r[0][i])] for i in keep], int), r[1][keep]

    rows = [(y, *only(r)) for y, r in zip(labels, one, strict=True)]
    pairs = [(a, b) for i, t in enumerate(texts) for a, b in toxicity.counterfactuals(t, i)]
    two, three = (toxicity.text_rates(pa.array([p[k] for p in pairs])) for k in (0, 1))
    told = [(*only(a), *only(b)) for a, b in zip(two, three, strict=True)]
    neutral = pa.array(["the muslim house by the green tree and water", "red scum green scum blue water tree house"])
    fair, plain = (toxicity.fit(rows, p, chosen).score(neutral) for p in (told, []))
    assert fair[0] < plain[0] and fair[0] < 0.5 < fair[1]
    # false positives on neutral mentions, with the penalty and without
    mentions = pa.array([" ".join(["the", rng.choice(["muslim", "jewish"]), *rng.choices(["red", "green", "blue", "house", "tree", "water"], k=12)]) for _ in range(200)])
    with_, without = ((toxicity.fit(rows, p, chosen).score(mentions) >= 0.5).mean() for p in (told, []))
    assert with_ <= without and with_ < 0.05


def test_swaps_stay_in_kind_and_language():
    assert toxicity.swapped("the transgender people and the others", 0).split()[1] in ("women", "men", "nonbinary")
    assert toxicity.swapped("die transgender und das", 0).split()[1] in ("frauen", "männer", "nichtbinär")
    assert toxicity.swapped("a bisexual, is it?", 1).split()[1] in ("gay,", "lesbian,", "straight,", "queer,")
    assert toxicity.swapped("no one", 0) is None
    two = toxicity.counterfactuals("The men left. Nothing here.\nSome asian food!", 0)
    assert [a for a, _ in two] == ["The men left", "Some asian food!"] and all(a != b for a, b in two)


# 6 ----------------------------------------------------------------------------


def test_rules(spark, odd, nothing):
    from oracle import compare, connect

    assert compare(spark, connect(SF), rules.op6_rule_ledger, rules.OP6_SQL, SF) == ""
    assert rules.ledger(nothing).count() == 0
    got = {r["doc_id"]: r for r in rules.apply_policy(rules.ledger(odd)).collect()}
    assert got[2]["n_words"] == 0 and got[2]["fail_bits"] == 1 and not got[4]["kept"]
    assert got[5]["n_repeat_words"] == 12000 and got[1]["fail_bits"] == 16
    assert got[7]["n_symbols"] == 4
    a = {r["rule"]: r for r in rules.ablations(rules.ledger(odd)).collect()}
    assert a["min_words"]["n_docs"] == 9 and a["repeat_words"]["n_failed"] == 1


# 7 ----------------------------------------------------------------------------


def test_substrings(spark, odd, nothing):
    rng = random.Random(1)
    docs = [(i if i else None, None if i % 13 == 0 else " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(50)]
    docs += [(5, "x y z " * 10), (5, "x y z " * 10), (7, "q " * 30), (8, "q " * 3)]
    df = spark.createDataFrame(docs, "doc_id long,text string")
    assert rows_of(substrings.dedup_substrings(df, window=6, gram=2, batches=3)) == sorted(substrings.brute_force(docs, 6), key=repr)
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(substrings.dedup_substrings(odd, window=8, gram=3)) == sorted(substrings.brute_force(plain, 8), key=repr)
    assert substrings.dedup_substrings(nothing).count() == 0


def test_index_runs_merge(spark):
    a = substrings.fingerprints(spark.createDataFrame([(1, " ".join(map(str, range(50))))], "doc_id long, text string"))
    ix = substrings.FingerprintIndex(spark, fanout=2)
    for _ in range(3):
        ix.add(a)
    assert len(ix.runs) == 1 and ix.merged().where("total = 3 and low = high").count() == ix.merged().count() > 0


# 8 ----------------------------------------------------------------------------


def test_decontamination(spark, odd, nothing):
    items = [(1, "A b c D"), (2, "c d e f g h"), (3, None), (4, "zz"), (None, "q"), (2, "é-1 x")]
    docs = [(1, "x a B, c-d e F g! h"), (2, None), (3, "ZZ zz q"), (3, "É é 1 X y"), (None, "c d e f")]
    it = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((b[:3] + b[5:] for b in decontaminate.brute_force(docs, items, 4)), key=repr)
    for size in (1 << 20, 8):
        found = decontaminate.find_contamination(df, it, window=4, shard_bytes=size)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_hit"] > 0) for r in found.collect()), key=repr) == want
    first = decontaminate.find_contamination(df, it, window=4).where("doc_id = 1").first()
    assert [docs[0][1][s["start"] : s["end"]] for s in first["spans"]] == ["a B, c-d e F g! h"] and first["item_ids"] == [1, 2]
    assert decontaminate.find_contamination(nothing, it).count() == 0
    assert decontaminate.find_contamination(odd, it.limit(0), carry=True).select("own.*").columns == odd.columns


def test_many_benchmarks_in_one_session(spark):
    """No automaton outlives its benchmark, and several automata find what one does."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(3, "a b c d " * 3000), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("own", F.lit("clash"))
    for k in range(12):
        items = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40)))) for i in range(3)] + [(9, "e f g a " * (k % 3) * 1200)]
        it = spark.createDataFrame(items, "item_id long, text string")
        found = decontaminate.find_contamination(df, it, window=5, **({"shard_nodes": 150 if k == 3 else 9_000} if k % 4 == 3 else {}))
        want = [(b[0], b[1], b[2], b[3]) for b in decontaminate.brute_force(docs[:-2], items[:3], 5)] if not k % 3 else None
        if want:
            assert rows_of(found.where("doc_id is not null and n_words < 100").select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"))) == sorted(want, key=repr)
        made = decontaminate.Matcher(items, 5)
        want = [(d, n, sum(b - a for a, b in iv), sorted(ids)) for d, t in docs for n, iv, ids in [made.scan(t)]]
        assert rows_of(found.select("doc_id", "n_words", "n_hit", "item_ids")) == sorted(want, key=repr)


def test_decontamination_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in docs_of(spark).collect()]
    items = [tuple(r) for r in docs_of(spark, "benchmark").collect()]
    assert rows_of(decontaminate.op8_aho_corasick_decontamination(spark, SF)) == sorted(decontaminate.brute_force(docs, items), key=repr)


# 9 ----------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", "a\\b [INST] <x>"), (1, 1, "assistant", "</s>[/INST]\\l"), (1, 1, "assistant", "</s>[/INST]\\l"), (None, None, None, None), (2, 5, "tool", "[:]"), (2, 1, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit("clash"))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(chat.events_of_rows(df))).collect()}
    assert got == chat.brute_force(rows)
    assert chat.read_back(chat.format_conversations(chat.events_of_rows(df.limit(0)))).count() == 0
    for role, text in (("user", "\\\\[<"), ("odd[:]role", "\\s"), ("assistant", "")):
        formatted, a, b = chat.render(role, text)
        assert chat.parse(formatted) == [(role, text)] and (role != "assistant" or chat.unescape(formatted[a:b]) == text)


def test_chat_query(spark):
    rows = [tuple(r) for r in docs_of(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.op9_event_sourced_chat(spark, SF).collect()} == chat.brute_force(rows)


def test_events_fold(spark):
    log = [(1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", "wr"), (1, 3, "delta", 2, "assistant", "ong"), (1, 4, "regenerate", 2, "assistant", ""),
           (1, 5, "delta", 2, "assistant", "go"), (1, 6, "delta", 2, "assistant", "od"), (1, 7, "message", 3, "user", "more"), (1, 8, "edit", 1, "user", "hello"), (1, 9, "message", 2, "assistant", "new")]
    schema = "conv_id long, seq long, kind string, msg long, role string, text string"
    assert [r["formatted"] for r in chat.format_conversations(spark.createDataFrame(log[:7], schema)).collect()] == ["[INST]hi[/INST]", "[ANS]good</s>", "[INST]more[/INST]"]
    assert [r["formatted"] for r in chat.format_conversations(spark.createDataFrame(log, schema)).collect()] == ["[INST]hello[/INST]", "[ANS]new</s>"]


# 10 ---------------------------------------------------------------------------


@pytest.mark.parametrize("shingle,percent,region", [(3, 90, 4096), (5, 80, 2)])
def test_jaccard(spark, monkeypatch, shingle, percent, region):
    monkeypatch.setattr(jaccard, "REGION", region)
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("qrstuv") for _ in range(n)] for n in (5, 12, 20, 40, 60, 90)]
    docs = []
    for i in range(140):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = rng.choice("XYZW") * rng.randint(1, 9)
        docs.append((i if i % 41 else None, " ".join(w)))
    docs += [(900, ""), (901, None), (902, "a b"), (903, "A  b"), (903, "A  b"), (None, "zz")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = jaccard.jaccard_components(df, shingle=shingle, percent=percent).select("doc_id", "n_shingles", "component_id")
    want = sorted(jaccard.brute_force(docs, shingle, percent), key=repr)
    assert rows_of(got) == want
    kept = jaccard.one_of_each(df, shingle=shingle, percent=percent)
    assert kept.columns == df.columns
    # every component keeps one; the two texts without words are their own
    assert len({r["doc_id"] for r in kept.where("doc_id is not null").collect()} - {w[2] for w in want}) == 0
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_sketches_bound_differences():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 40, 700, 900, 5000]
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in sizes]
    near = [np.unique(np.concatenate([x[len(x) // 10 :], rng.integers(0, 1 << 63, len(x) // 10).astype(np.uint64)])) for x in sets]
    every = [*sets, *near]
    made = jaccard.parities(np.concatenate(every), np.concatenate([[0], np.cumsum([len(x) for x in every])]))
    assert len(made) == len(every) and len(made[5]) * 64 >= jaccard.WIDE * 5000
    for x, a in zip(every, made, strict=True):
        for y, b in zip(every, made, strict=True):
            words = min(len(a), len(b))
            bits = int(np.bitwise_count(jaccard.folded(a, words) ^ jaccard.folded(b, words)).sum())
            assert bits <= len(np.setxor1d(x, y)) and (bits > 0) == (len(np.setxor1d(x, y)) > 0)


def test_jaccard_names_that_collide(spark):
    """Classes whose first names are equal are told apart, whatever their number."""
    docs = [(i, f"a{i % 7} b{i % 7} c d e f g h i j k{i % 3}") for i in range(40)] + [(50, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.jaccard_components(df, shingle=2, percent=70, bits=2).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == sorted(jaccard.brute_force(docs, 2, 70), key=repr)


def test_jaccard_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in docs_of(spark).collect()]
    assert rows_of(jaccard.op10_jaccard_metric_join(spark, SF)) == sorted(jaccard.brute_force(docs), key=repr)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 30), (40, 40)], "u long, v long")
    assert dict(rows_of(graphs.components(chain))) == {**{i: 1 for i in range(1, 21)}, 30: 30, 31: 30}


# -------------------------------------------------------------------------------


def test_pipeline(spark):
    """Each stage on its own input, against brute force where one exists."""
    import corpus_pipeline as cp

    docs = docs_of(spark)
    columns, items = docs.columns, [tuple(r) for r in docs_of(spark, "benchmark").collect()]
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if k < 4 else None
        docs = cp.written(stage(spark, docs, SF), "stage")
        sizes.append(docs.count())
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == columns
        if k == 2:
            assert ids == {c for _, _, c in jaccard.brute_force(before, 5, 80)}
        if k == 3:
            assert ids == {b[0] for b in decontaminate.brute_force(before, items) if not b[5]}
            kept = ids
        if k == 4:
            assert ids == kept
            check_packing(docs.collect(), 2048)
    assert sizes[1] >= 0.98 * sizes[0] and sizes[3] < sizes[2] <= sizes[1]
