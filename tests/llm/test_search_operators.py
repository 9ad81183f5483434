"""Joins, repeated strings, vector search and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("raggedlake.llm")
P = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from raggedlake.llm import graph, ngram_join, queries, suffix_dedup, vector_index  # noqa: E402

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)], FIELDS)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(texts, n, p, q):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return [find(a) for a in range(len(texts))], sets


def family_texts(seed=5):
    rng = random.Random(seed)
    texts = [None, "", "  ", "one", "ONE", "one two", "a a a a a"]
    for size in (4, 12, 40, 90, 300):
        base = sentence(rng, size).split()
        for k in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + size // 25)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
            texts.append(" ".join(w[: len(w) - rng.randrange(0, 1 + size // 40)]))
    texts += [sentence(rng, 60) for _ in range(20)] + [texts[20]] * 5
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("n", "limit", "grams"), [(3, Fraction(9, 10), 3_000_000), (5, Fraction(4, 5), 3_000_000), (3, Fraction(9, 10), 600)])
def test_jaccard_components(spark, monkeypatch, n, limit, grams):
    monkeypatch.setattr(ngram_join, "TASK_GRAMS", grams)  # small: components are cut into blocks
    monkeypatch.setattr(ngram_join, "TASK_DOCS", 6_000 if grams > 600 else 5)
    texts = family_texts()
    want, sets = brute_components(texts, n, limit.numerator, limit.denominator)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs(spark, texts), n, limit).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))


def test_many_near_copies_take_the_star(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BATCH", 500)
    rng = random.Random(2)
    base = sentence(rng, 120).split()
    texts = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(w))
    got = ngram_join.jaccard_components(docs(spark, texts).repartition(6), 3, Fraction(9, 10)).collect()
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == brute_components(texts, 3, 9, 10)[0]


def test_bitmaps_never_rule_out_a_link():
    """Differing bits are at most the differing n-grams at any pair of sizes, and tell long unrelated sets apart."""
    rng = np.random.default_rng(8)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    sets = []
    for n in (1, 3, 50, 900, 1024, 1100, 2048, 2300, 9000, 16000):
        base = draw(n)
        sets += [base, np.unique(np.concatenate([base[: n - n // 20], draw(n // 20 + 1)])), base[: max(1, int(n * 0.85))], draw(n)]
    maps = list(map(ngram_join.bitmap, sets))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    differ = ngram_join.apart([maps[a] for a, _ in pairs], [maps[b] for _, b in pairs])
    for (a, b), d in zip(pairs, differ.tolist()):
        assert d <= len(np.setxor1d(sets[a], sets[b]))
    for a, b in ((35, 32), (39, 36)):  # unrelated sets of 9 000 and 16 000
        assert differ[pairs.index((a, b))] > (len(sets[a]) + len(sets[b])) // 9
    limit = Fraction(4, 5)
    n = np.array(list(map(len, sets)))
    order = rng.permutation(len(sets))
    links = ngram_join._forest_of_possible(n[order], [maps[i] for i in order], None, limit)
    root = list(range(len(sets)))
    for a, b in links:
        x, y = root[order[a]], root[order[b]]
        root = [x if r == y else r for r in root]
    for a, b in pairs:
        if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])):
            assert root[a] == root[b]
    assert root[35] != root[32] and root[39] != root[36]


def test_jaccard_nulls_and_empty(spark):
    rows = [(None, "a b c d", None, None, None, None), (None, None, None, None, None, None), (4, "a b c d", None, None, None, None), (4, "a b c d", None, None, None, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, FIELDS)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, -1), (4, 4), (4, 4)]
    assert ngram_join.jaccard_components(spark.createDataFrame([], FIELDS)).count() == 0


def test_divide_skip_finds_all_partners():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 190, replace=False), rng.integers(0, 2**63, 4).astype(np.uint64)])) for _ in range(40)]
    limit = Fraction(17, 20)
    s = ngram_join.Search(sets, limit)
    for r in range(len(sets)):
        want = {b for b in range(len(sets)) if (len(sets[b]), b) > (len(sets[r]), r) and 20 * len(np.intersect1d(sets[r], sets[b])) >= 17 * len(np.union1d(sets[r], sets[b]))}
        assert set(s.partners(r, lambda p: np.ones(len(p), bool)).tolist()) == want


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (1, 7), (7, 6), (6, 5), (20, 21)], "a long, b long")
    got = {r["id"]: r["label"] for r in graph.components(edges).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8, 20: 20, 21: 20}
    assert graph.components(edges.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    """Ten thousand nodes in one path, with shuffled names and repeated edges."""
    names = np.random.default_rng(3).permutation(10_000).tolist()
    edges = spark.createDataFrame([*zip(names, names[1:]), *zip(names[1:50], names[:49])], "a long, b long")
    got = graph.components(edges)
    assert (got.count(), got.where("label = 0").count()) == (10_000, 10_000)


def brute_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        keep = bytes(np.frombuffer(t, np.uint8)[~gone])
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(keep).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "shard"), [(200, 1_500_000), (50, 1_500_000), (50, 1500), (37, 1500)])
def test_repeated_bytes(spark, monkeypatch, length, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)  # small: anchors are cut into blocks that are merged
    rng = random.Random(7)
    passage = sentence(rng, 60)
    texts = [None, "", "short", "ab" * 300, "x" * 199, "é" * 150, "aé" * 150, passage[:length], "\0" * 120]
    texts += [sentence(rng, 40) + passage[rng.randrange(20) : 200 + rng.randrange(80)] + sentence(rng, 40) for _ in range(40)]
    texts += [sentence(rng, 100) for _ in range(5)]
    texts += [texts[-1], texts[20], texts[20] + "!"]
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs(spark, texts), length).collect()}
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == brute_cut(texts, length)


def test_shards_of_texts_with_nul_bytes():
    """Suffix arrays, common prefixes and binary search where texts hold the byte that separates runs inside a shard."""
    rng = random.Random(11)
    for case in range(400):
        letters, length = (b"\0a", b"\0\xff", b"ab")[case % 3], (3, 8, 9, 17)[case % 4]
        parts = [[bytes(rng.choice(letters) for _ in range(length + rng.randrange(12))) for _ in range(rng.randrange(1, 5))] for _ in range(2)]
        starts = [np.array([len(p) - length + 1 for p in side]) for side in parts]
        a, b = (suffix_dedup.Shard(p, s, length) for p, s in zip(parts, starts))
        windows = [[p[i : i + length] for p in side for i in range(len(p) - length + 1)] for side in parts]
        many = Counter(windows[0])
        assert a.repeats().tolist() == [many[w] > 1 for w in windows[0]]
        assert a.holds(b).tolist() == [w in many for w in windows[1]] and b.holds(a).tolist() == [w in set(windows[1]) for w in windows[0]]


def test_repeated_bytes_with_nul_bytes(spark, monkeypatch):
    rng = random.Random(12)
    odd = lambda n: "".join(rng.choice("\0\0\0a") for _ in range(n))
    passage = odd(90)
    texts = [odd(rng.randrange(40, 160)) + (passage[rng.randrange(30) :] if i % 2 else "") + odd(rng.randrange(30)) for i in range(30)]
    for shard in (1_500_000, 1500):
        monkeypatch.setattr(suffix_dedup, "SHARD", shard)
        got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs(spark, texts), 40).collect()}
        assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == brute_cut(texts, 40)


def test_least_id_is_no_null(spark):
    t = sentence(random.Random(1), 100)
    got = suffix_dedup.dedup(spark.createDataFrame([(-(1 << 63), t), (None, t), (2, t + "x")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in got) == [(False, -(1 << 63), len(t)), (False, 2, len(t)), (True, 0, len(t))]


def test_repeated_rows_and_empty_table(spark):
    t = sentence(random.Random(1), 100)
    got = suffix_dedup.dedup(spark.createDataFrame([(1, t), (1, t), (None, "x"), (None, None)], "doc_id long, text string"), with_bytes=True).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 0), (-1, 0), (1, len(t)), (1, len(t))]
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for text in (b"banana" * 40, bytes(rng.integers(97, 99, 500).astype(np.uint8)), b"a" * 300):
        sa, rank = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8).astype(np.int64) + 1)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:]) and (rank[sa] == np.arange(len(text))).all()


def brute_nearest(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 10 == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16))
    x = (centers[rng.integers(6, size=900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    x[500:] = x[500] + 1e-4 * rng.normal(size=(400, 16)).astype(np.float32)  # one list holds nearly half of all rows
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1010, [float("nan")] * 16, 0), (1020, [None] * 16, 0), (1030, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    want = brute_nearest(np.arange(900), x.astype(np.float64), 10)
    got = {}
    for r in vector_index.search(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {}
    for r in vector_index.search(df, F.col("vec_id") % 10 == 0, probed=1.0).orderBy("query_id", "rank").collect():
        exact.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert exact == want


def test_vector_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = vector_index.search(df, F.col("vec_id") % 2 == 0, lists=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert vector_index.search(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_vector_search_of_repeated_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] * 12, "vec_id long, embedding array<double>").repartition(4)
    want = brute_nearest(np.arange(150), x, 10)
    got = {}
    for r in vector_index.search(df, F.col("vec_id") % 10 == 0, probed=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want


@pytest.mark.parametrize("clusters", [1, 40])
def test_vector_search_recall_at_the_measured_lists(spark, clusters):
    """As shipped: at least 0.9 of the true neighbours, and few lists where the vectors cluster."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(clusters, 12))[rng.integers(clusters, size=6000)] * 4 + rng.normal(size=(6000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ids = np.arange(6000)
    got = {}
    for r in vector_index.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in ids[::100]:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.lexsort((ids, d))[:10].tolist()))
    assert hits >= 0.9 * 600
    if clusters > 1:
        books = vector_index.Codebooks(x, 77)
        assert books.needed(x, 10) <= 0.4 * len(books.coarse)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    shared = sentence(rng, 70)
    texts = [sentence(rng, 80) + ("" if i % 9 else " " + shared) for i in range(60)]
    texts += [texts[3] + " tail", texts[4], None, "", "### $$$ " * 40] + [" ".join(["SPAM!!"] * 50) + f" {i}" for i in range(10)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 62), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, at = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / name))
        d = at[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert d.columns == corpus_pipeline.COLUMNS
    ids = lambda n: {r["doc_id"] for r in at[n].select("doc_id").collect()}
    assert ids("quality_classifier") >= set(range(60)) and not ids("quality_classifier") & set(range(62, len(texts)))
    kept = [r for r in at["quality_classifier"].orderBy("doc_id").collect()]
    roots, _ = brute_components([r["text"] for r in kept], 5, 4, 5)
    assert ids("ngram_join") == {kept[r]["doc_id"] for r in set(roots)} and 3 in ids("ngram_join") and 60 not in ids("ngram_join")
    before = at["ngram_join"].orderBy("doc_id").collect()
    after = at["suffix_dedup"].orderBy("doc_id").collect()
    for r, (_, _, _, sha) in zip(after, brute_cut([b["text"] for b in before], 200)):
        assert hashlib.sha256(r["text"].encode()).hexdigest() == sha and r["n_chars"] == len(r["text"])
    assert not any(shared[:200] in r["text"] for r in after)
    assert {r["doc_id"] for r in at["packing"].collect()} == ids("suffix_dedup")
    got = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset")
    assert got.exceptAll(at["packing"].drop("sequence_id", "offset")).isEmpty()


def test_queries_are_registered():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in queries.QUERIES


def test_signatures_of_sets_that_link_meet_and_others_seldom():
    """Any order of n-grams lets linked sets meet; unrelated texts that share frequent n-grams don't (parts without n-grams once made all meet)."""
    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    levels = rng.integers(0, 64, 1 << (64 - int(ngram_join.CELL))).astype(np.uint8)
    for limit in (Fraction(4, 5), Fraction(9, 10)):
        for n in (1, 2, 5, 9, 10, 40, 333):
            for _ in range(40):
                base = draw(n)
                most = int((1 - limit) / (1 + limit) * 2 * n)
                other = np.unique(np.concatenate([rng.permutation(base)[: n - rng.integers(0, most + 1)], draw(rng.integers(0, most + 1))]))
                if len(np.intersect1d(base, other)) >= limit * len(np.union1d(base, other)):
                    assert len(np.intersect1d(ngram_join.prefix(base, limit, levels), ngram_join.prefix(other, limit, levels)))
    often, levels = draw(100), np.zeros_like(levels)
    levels[(often >> ngram_join.CELL).astype(np.int64)] = 20
    sigs = [ngram_join.prefix(np.unique(np.concatenate([often, draw(300)])), Fraction(4, 5), levels) for _ in range(50)]
    assert len(np.unique(np.concatenate(sigs))) == sum(map(len, sigs))


def test_frequent_ngrams_are_counted(spark):
    rng = random.Random(6)
    shared = sentence(rng, 30)
    texts = [sentence(rng, 40) + " " + shared for _ in range(40)] + [None, ""]
    levels = ngram_join._levels(docs(spark, texts).select("text"), 5)
    inside, own = ngram_join.gram_sets([shared.encode(), texts[0].encode()], 5)
    level = levels[(inside >> ngram_join.CELL).astype(np.int64)]
    assert level.min() >= 3 and np.count_nonzero(levels) <= 2 * len(inside) and len(own) > len(inside)


def test_parts_are_for_high_limits():
    assert not ngram_join.Bands(Fraction(9, 10)).thin() and ngram_join.Bands(Fraction(4, 5)).thin()
