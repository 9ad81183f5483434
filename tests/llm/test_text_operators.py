"""Encoders, packing, rules, scores and licences against libraries and brute force."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

pytest.importorskip("raggedlake.llm")
P = pytest.importorskip("public_tokenizers")

from raggedlake.llm import byte_bpe, license_scan, packing, quality_classifier, quality_rules, token_counts, toxicity  # noqa: E402

ODD = [None, "", " ", "a   b", "x\n\ny", " \n  z", "I'll don't 'ral", "<|endoftext|>hi<|endoftext|>", "日本語 テキスト é́", "tr   ", "x  y", "aa " * 3000, "Σς İK", "tab\tand\r\nline"]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in zip(ids or range(len(texts)), texts)], FIELDS)


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], FIELDS)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = P.path("byte_bpe_50k.json")
    got = collect(token_counts.token_counts(docs(spark, ODD), path, P.PATTERN))
    for i, t in enumerate(ODD):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert token_counts.token_counts(empty(spark), path, P.PATTERN).count() == 0
    c = token_counts.PrefixCounter(path, P.PATTERN)
    for t in ("I'll don't \n\n 'ral  x", "unbelievable  日本語 é"):
        stored = c.prefix_table(t)
        assert [c.count_at(t, p, stored) for p in range(len(t) + 1)] == [len(lib.encode(t[:p], add_special_tokens=False).ids) for p in range(len(t) + 1)]
    cuts = collect(token_counts.budget_cuts(docs(spark, ["one two three four five", None]), path, P.PATTERN, 3))
    assert (cuts[0]["cut_chars"], cuts[0]["cut_tokens"], cuts[0]["n_tokens"]) == (13, 3, 5) and cuts[1]["cut_chars"] == 0


def test_token_prefixes_end_at_any_character(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["QUJD" * 60, "a  <|endoftext|> b<|endoftext|>", "we'll don't 'ral  x", "x \n\n  日本語é́  ", "1234567 ###$$$ tr   "]
    many = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    c = token_counts.PrefixCounter(path, P.PATTERN)
    for t in texts:
        assert [int(n) for n in c.prefix_table(t)] == [many(t[:k]) for k in range(len(t) + 1)]
    cuts = collect(token_counts.budget_cuts(docs(spark, texts), path, P.PATTERN, 4))
    for i, t in enumerate(texts):
        longest = max(k for k in range(len(t) + 1) if many(t[:k]) <= 4)
        assert (cuts[i]["n_tokens"], cuts[i]["cut_chars"], cuts[i]["cut_tokens"]) == (many(t), longest, many(t[:longest]))
    assert cuts[0]["cut_chars"] > 0


def test_byte_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = collect(byte_bpe.encode_texts(docs(spark, ODD), path, P.PATTERN))
    short = collect(byte_bpe.encode_texts(docs(spark, ODD), path, P.PATTERN, digests=True))
    for i, t in enumerate(ODD):
        ids = lib.encode_ordinary(t or "")
        assert got[i]["token_ids"] == ids and bytes(got[i]["decoded"]) == (t or "").encode()
        assert short[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and short[i]["n_tokens"] == len(ids)
    assert byte_bpe.encode_texts(empty(spark), path, P.PATTERN).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [*ODD, *[f"word{i} and some more text here " * (i * 7 % 200) for i in range(120)]]
    rows = packing.pack(docs(spark, texts), path, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) > 0
    for i, t in enumerate(texts):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in parts for x in r["ids"]] == want and all(r["doc_tokens"] == len(want) for r in parts)
        assert all(a["start"] + a["length"] == b["start"] for a, b in pairwise(parts)) and parts[0]["start"] == 0
    padding = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in parts)
        assert parts[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in pairwise(parts)) and total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding <= 0.04 * sum(r["length"] for r in rows)
    assert packing.pack(empty(spark), path).count() == 0
    for n in (1, 2, 682, 683, 1024, 1500, 2047, 2048, 5000):
        assert sum(packing.cut(n)) == n


def brute_stats(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(grams)
    inside = {k for i, g in enumerate(grams) if many[g] > 1 for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_quality_rules(spark):
    clean = [" ".join(f"w{(i * 31 + k * 17) % 997}x{k}" for k in range(60)) + "." for i in range(60)]
    junk = [" ".join(f"w{k}{i}###$$$" for k in range(60)) for i in range(5)]
    texts = [*ODD, "a b c d e f g h a b c d e f g h", "l one\nl one\n \n \nl two", *clean, *junk]
    got = collect(quality_rules.quality_rules(docs(spark, texts)))
    for i, t in enumerate(texts):
        r, want = got[i], brute_stats(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    first = len(ODD) + 2
    assert all(got[i]["kept"] for i in range(first, first + len(clean)))
    assert not any(got[i]["kept"] for i in range(first + len(clean), len(texts)))
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, clean[0], None, None, None, None)] * 2, FIELDS)
    assert [r["kept"] for r in quality_rules.quality_rules(nulls).collect()] == [True, True]


def test_sketch_quantiles_are_close_and_merge(spark):
    df = spark.range(1, 2001).selectExpr("id / 10.0D as m", "id % 4 as g")
    one = quality_rules.sketch(df.selectExpr("m", "0 as g"), ["g"], ["m"])
    parts = quality_rules.merge(quality_rules.sketch(df, ["g"], ["m"]), [])
    a = quality_rules.quantiles(one, ["g"], {"q": 0.5, "low": 0.1}).first()
    b = quality_rules.quantiles(parts, [], {"q": 0.5, "low": 0.1}).first()
    assert (a["q"], a["low"]) == (b["q"], b["low"])
    assert abs(a["q"] - 100) <= 2.1 and abs(a["low"] - 20) <= 0.5


def test_quality_classifier(spark):
    good = [" ".join(f"w{(i * 31 + k * 17) % 997}x{k}" for k in range(60)) for i in range(80)]
    bad = [" ".join(["SPAM!!"] * 40) + f" {i}" for i in range(80)]
    d = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    got = collect(quality_classifier.quality_scores(d, labels))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert sum(got[i]["predicted"] == int(i < 80) for i in range(160) if got[i]["held_out"]) >= 0.98 * sum(got[i]["held_out"] for i in range(160))
    assert got[160]["score"] == got[161]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in quality_classifier.keep_good(d, labels).collect()}
    assert kept == {i for i, r in got.items() if r["score"] >= 0.5}
    none = quality_classifier.quality_scores(d, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_classifier.quality_scores(empty(spark), labels).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    plain = [" ".join(f"w{x}" for x in rng.integers(0, 300, 40)).replace("w", "word") for _ in range(300)]
    plain = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t) for t in plain]
    texts = [t + " IDIOT!! wordab scum, " + t if i % 3 == 0 else t for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    d = docs(spark, [*texts, None, "", "!!!"])
    got = collect(toxicity.toxic_scores(d, labels))
    held = [i for i in range(300) if got[i]["held_out"]]
    assert held == [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in held)
    spans = {texts[0][s["start"] : s["end"]].strip("!,.").lower() for s in got[0]["spans"]}
    assert spans and all("idiot" in x or "scum" in x for x in spans)
    assert {got[i]["score"] for i in (300, 301, 302)} == {toxicity.BASE}
    assert {r["score"] for r in toxicity.toxic_scores(d, labels.limit(0)).collect()} == {toxicity.BASE}
    assert toxicity.toxic_scores(empty(spark), labels).count() == 0


def test_toxicity_markers_of_a_rare_language():
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghij"))
    plain = lambda start: [start + "".join(rng.choice(letters, 3)) for _ in range(12)]
    bad = lambda start, word: [*(x := plain(start))[:6], word, *x[6:]]
    toxic = [bad("en", "idiot") for _ in range(400)] + [bad("es", "boco") for _ in range(25)]
    clean = [plain("en") for _ in range(400)] + [plain("es") for _ in range(25)]
    assert {w for w in toxicity.markers(toxic, clean) if not w.startswith("^")} == {"idiot", "boco"}


def test_forward_backward_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    known = {"bad": 1, "near": 2}
    for text in ("bad x near x x bad y", "x y bad near", "x x x bad", "bad", "near bad x x x x"):
        f = toxicity.Field(known, rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
        words = text.split()
        kinds = [f.kinds[w] for w in words]
        at = [i for i, k in enumerate(kinds) if k]
        p = np.zeros(len(words))
        total = 0.0
        for path in product((0, 1), repeat=len(words)):
            w = f.start[path[0]] * np.prod([f.emit[k][s] for k, s in zip(kinds, path)]) * np.prod([f.step[a, b] for a, b in pairwise(path)])
            total += w
            p += w * np.array(path)
        assert np.allclose(f.marginals(at, [kinds[i] for i in at], len(words)), (p / total)[at])


def test_toxicity_scores_of_long_texts_equal_the_plain_recursion():
    """Scores of whole texts, over long gaps too, by forward-backward vectors word after word in numpy."""
    rng = np.random.default_rng(8)
    f = toxicity.Field({"bad": 1, "near": 2, "^badg": 3}, rng.normal(size=(4, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    for size in (1, 30, 3000):
        words = rng.choice(["bad", "near", "badger", *["x"] * 60], size).tolist()
        emit = np.array([f.emit[f.kinds[w]] for w in words])
        fore, back = np.empty((size, 2)), np.ones((size, 2))
        for i in range(size):
            v = f.start * emit[0] if i == 0 else (fore[i - 1] @ f.step) * emit[i]
            fore[i] = v / v.sum()
        for i in range(size - 2, -1, -1):
            v = f.step @ (emit[i + 1] * back[i + 1])
            back[i] = v / v.sum()
        p = fore * back
        p = p[:, 1] / p.sum(1)
        known = [k for k, w in enumerate(words) if f.kinds[w]]
        score, spans = f.tag(" ".join(words))
        assert np.isclose(score, max([toxicity.BASE, *p[known]]))
        assert sum(len(" ".join(words)[s:e].split()) for s, e, _ in spans) == sum(p[k] >= 0.5 for k in known)


def test_license_scan(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.", "c"),
        (2, "a/x/one.txt", "nothing here", "c"),
        (3, "a/x/y/LICENSE", "Licensed under the Apache License, Version 2.0.", "c"),
        (4, "a/x/y/z/two.txt", "plain", "c"),
        (5, "a/x/y/three.txt", "text\nThis work is licensed under the GNU General Public License, version 3.", "c"),
        (6, "b/four.txt", None, "c"),
        (7, "top.txt", "", "c"),
        (8, None, "we are licensed to do the things in this general and public place of work under no terms", "c"),
        (2, "a/x/one.txt", "nothing here", "c"),
    ] + [(100 + i, f"c/{i}.txt", f"some plain words number {i}", "c") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, path string, text string, own_license string")
    got = license_scan.license_scan(df, "id", "path").collect()
    by = {r["id"]: (r["license"], r["license_from"], r["license_dir"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("MIT", "own", None) and by[2] == ("MIT", "inherited", "a")
    assert by[4] == ("Apache-2.0", "inherited", "a/x/y") and by[5] == ("GPL-3.0", "own", None)
    assert by[6] == by[7] == by[8] == (None, None, None) and by[100] == (None, None, None)
    assert license_scan.license_scan(df.limit(0), "id", "path").count() == 0


def scan(spark, texts, paths=None):
    rows = [(i, p, t) for i, (p, t) in enumerate(zip(paths or [f"d{i}/x.txt" for i in range(len(texts))], texts))]
    got = license_scan.license_scan(spark.createDataFrame(rows, "id long, path string, text string"), "id", "path").collect()
    return {r["id"]: r for r in got}


def test_license_scan_short_forms(spark):
    plain = [f"some plain words number {i}" for i in range(40)]
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."
    texts = ["a\nAll rights reserved.\nb", f"All rights reserved.\n{bsd}", "# SPDX-License-Identifier: GPL-2.0-or-later\nx", "// SPDX-License-Identifier: (MIT OR Zlib)", "SPDX-License-Identifier: Zlib", "MIT License\n\nx", *plain]
    got = scan(spark, texts)
    assert [got[i]["own_license"] for i in range(7)] == ["Proprietary", "BSD-3-Clause", "GPL-2.0", "MIT", None, "MIT", None]
    assert got[0]["own_score"] == got[1]["own_score"] == got[2]["own_score"] == 1.0


def test_license_scan_of_a_common_notice(spark):
    texts = ["head\nReleased under the MIT License.\nbody", "plain words"] * 20
    got = scan(spark, texts)
    assert [got[i]["own_license"] for i in range(40)] == ["MIT", None] * 20


def test_license_scan_wrapped_and_joined_notices(spark):
    plain = [f"some plain words number {i}" for i in range(60)]
    wrapped = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted. BSD 3-Clause License.\ncode"
    joined = "code of the parser and the printer // Released under the MIT License. Written by nobody for the sake of a test of long lines"
    got = scan(spark, [wrapped, joined, "Released under\nthe MIT\nLicense.", "we are released under no terms", *plain])
    assert [(got[i]["own_license"], got[i]["own_score"]) for i in range(5)] == [("BSD-3-Clause", 1.0), ("MIT", 1.0), ("MIT", 1.0), (None, None), (None, None)]


def test_license_scan_inherits_from_the_root(spark):
    mit = "Released under the MIT License."
    got = scan(spark, [mit, "x", "x", "Licensed under the Apache License, Version 2.0.", "x", "x"], ["LICENSE", "src/a.py", "b.py", "src/deep/LICENSE", "src/deep/er/c.py", None])
    assert [(got[i]["license"], got[i]["license_dir"]) for i in range(6)] == [("MIT", None), ("MIT", ""), ("MIT", ""), ("Apache-2.0", None), ("Apache-2.0", "src/deep"), (None, None)]
    for own in (["/LICENSE", "/src/a.py"], ["LICENSE", "a.py"]):
        assert [r["license"] for r in scan(spark, [mit, "x"], own).values()] == ["MIT", "MIT"]


def brute_cosine(texts, units, match=0.8):
    """The best licence of some units (bags of terms) by TF-IDF cosine, with the weights of the texts; nothing of the operator's own."""
    import math

    n = len(texts)
    seen = Counter(t for x in texts for t in set(re.findall("[a-z0-9]+", (x or "").lower())))
    vocabulary = {t for _, x in license_scan._notices() for t in re.findall("[a-z0-9]+", x.lower())}
    weight = lambda t: math.log((n + 1) / ((seen[t] if t in vocabulary else 0) + 1)) + 1
    vec = lambda bag: {t: c * weight(t) for t, c in Counter(bag).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = (0.0, "")
    for bag in units:
        v = vec(bag)
        for name, x in license_scan._notices():
            u = vec(re.findall("[a-z0-9]+", x.lower()))
            if v:
                best = min(best, (-round(sum(v.get(t, 0) * y for t, y in u.items()) / size(u) / size(v), 9), name))
    return (best[1], -best[0]) if -best[0] >= match else (None, None)


def test_license_scan_equals_plain_cosines(spark):
    """Lines and whole licence files, by independent arithmetic; runs across lines are switched off by lines that repeat no notice."""
    rng = np.random.default_rng(9)
    notices = [x for _, x in license_scan._notices()]
    texts, paths = [], []
    for i in range(60):
        words = re.findall("[A-Za-z0-9]+", notices[i % len(notices)])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = f"other{rng.integers(50)}"
        texts.append(" ".join(words))
        paths.append(f"d{i}/" + ("LICENSE" if i % 2 else "x.txt"))
    texts += ["one two\n\nthree", "", None]
    paths += ["e/LICENSE", "e/y.txt", "e/z.txt"]
    got = scan(spark, texts, paths)
    for i, t in enumerate(texts):
        units = [re.findall("[a-z0-9]+", x.lower()) for x in (t or "").split("\n")] + ([re.findall("[a-z0-9]+", (t or "").lower())] if paths[i].endswith("LICENSE") else [])
        name, score = brute_cosine(texts, units)
        if name is not None and name != license_scan.WEAK:
            assert got[i]["own_license"] is not None and got[i]["own_score"] >= score - 1e-6, (i, name, score, got[i])
        if got[i]["own_license"] is None:
            assert name is None
    exact = [i for i in range(len(notices)) if texts[i].lower() == " ".join(re.findall("[a-z0-9]+", notices[i].lower()))]
    assert exact and all(got[i]["own_score"] == 1.0 for i in exact)


def test_license_texts_in_files_and_headers(spark):
    mit, gpl = license_scan.TEXTS["MIT"], license_scan.TEXTS["GPL-2.0"]
    plain = [f"some plain words number {i}" for i in range(60)]
    header = "/*\n" + "\n".join(" * " + x.strip() for x in gpl.split("\n")) + "\n */\nint main() {}\n" + " ".join(plain)
    long_text = " ".join(f"w{i % 7919}" for i in range(40_000)) + " license public"
    texts = [f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{mit}", mit.replace("\n", " "), header, long_text, *plain]
    got = scan(spark, texts, ["a/LICENSE", "b/COPYING", "c/main.c", "d/LICENSE", *[f"e/{i}" for i in range(60)]])
    assert [got[i]["own_license"] for i in range(4)] == ["MIT", "MIT", "GPL-2.0", None]
    assert got[1]["own_score"] == 1.0 and all(got[4 + i]["own_license"] is None for i in range(60))


def test_toxicity_keeps_its_context_words():
    letters = "abcdefghij"
    near = [f"n{letters[i // 100]}{letters[i // 10 % 10]}{letters[i % 10]}" for i in range(600)]
    toxic = [(" ".join(["idiot", near[k % 600], near[(k + 1 + k // 600) % 600]]) + f" {k}", 1) for k in range(6600)]
    field = toxicity.fit([*toxic, *[(t.replace("idiot", "plain"), 0) for t, _ in toxic]])
    assert sum(w in field.known for w in near) == 600


def test_byte_bpe_of_long_and_repeated_texts(spark, monkeypatch):
    """A word of 100 000 letters, repeated rows, and tasks that share pieces (these are folded once and broadcast)."""
    import random

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    words = [letters(rng.randrange(1, 14)) for _ in range(300)]
    texts = [letters(100_000), "a" + letters(255), "a" + letters(256), "é" * 300, "x" * 5000, "short " + letters(700) + " end " + letters(300)]
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(80)]
    texts += [texts[7]] * 3 + ODD
    got = collect(byte_bpe.encode_texts(docs(spark, texts).repartition(6), path, P.PATTERN))
    monkeypatch.setattr(byte_bpe, "COMMON", 0)
    none = collect(byte_bpe.encode_texts(docs(spark, texts).repartition(6), path, P.PATTERN, digests=True))
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        assert got[i]["token_ids"] == ids and bytes(got[i]["decoded"]) == (t or "").encode()
        assert none[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    for t in ("ab" * 400, letters(600)):
        assert byte_bpe.heap_merge(t.encode(), ranks) == lib.encode_ordinary(t)


def test_packing_merges_words_without_the_library(monkeypatch):
    """Random letters, signs and combining marks equal the library's ids; plain words don't go to it, which costs most of the time."""
    import random

    path = P.path("word_bpe_49k.json")
    rng, some = random.Random(1), "abcdefghijklmnopqrstuvwxyzABZ  \t\n0159.,;:!?<|>#-_()éÉüßñçÀ̀́İſŉKÅΣς中あ한😀𝒜𝟘٣½²Ⅷ\xa0　​\x1c\x85\x00;Ωʹ`ﬁ"
    texts = ["".join(rng.choices(some, k=rng.randint(0, 60))) for _ in range(3_000)] + ["x" * 64, "." * 64, "ab" * 32, "", " "]
    enc = packing.WordEncoder(path)
    with monkeypatch.context() as m:
        m.setattr(packing.WordEncoder, "library_ids", None)
        got = enc.encode([t.replace("<|", "<") for t in texts])
    assert [x.tolist() for x in got] == [e.ids for e in enc.tokenizer.encode_batch([t.replace("<|", "<") for t in texts], add_special_tokens=False)]
    texts += ["It's we'll DON'T l'eau 's", "<|startoftext|>a <|endoftext|>", "a<|b", "x" * 5_000, "ab" * 70 + "." * 99]
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_held_in_plain_arrays():
    """A task's pieces take little more than their ids; a text of many pieces is put together in steps."""
    import pyarrow as pa

    ids = [[i, i + 1, 7][: 1 + i % 3] for i in range(20_000)]
    have = byte_bpe.Pieces(np.empty(0, np.int32), np.empty(0, np.int32))
    for k in range(0, 20_000, 5_000):
        have.add(pa.array(ids[k : k + 5_000] + [[k]] * (k > 0), pa.list_(pa.int32())), int(k > 0))
    assert sum(x.nbytes for x in (have.size, have.flat, have.offs)) == 12 * 20_000 + 4 * sum(map(len, ids))
    at = np.array([3, -1, 19_999, -3, 0] + list(range(20_000)) * 4, np.int32)
    want = [ids[a] if a >= 0 else [5_000 * -int(a)] for a in at.tolist()]
    assert have.text(at).tolist() == [i for x in want for i in x]
    flat, offs, size = byte_bpe.token_bytes({b"b": 0, b"": 1, b"ab": 3})
    assert byte_bpe.gathered(flat, offs, size, np.array([3, 0, 1, 3])).tobytes() == b"abbab"


def test_byte_bpe_cells(spark):
    """A merge looks up the pairs on its two sides alone: the fold's cells equal tiktoken for pieces of any length; rows hold a bounded number of new pieces."""
    import random
    import types

    import pyarrow as pa
    import tiktoken
    from pyspark.sql import functions as F

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    some = lambda n, k: bytes(rng.choice(k) for _ in range(n))
    pieces = [some(rng.randrange(1, 20), b" etaoinshrdlu") for _ in range(400)] + [some(rng.randrange(1, 9), range(256)) for _ in range(200)]
    pieces += [b"a" * n for n in range(1, 40)] + [b"\x00", b"\xff", b" ", some(byte_bpe.LONG, b"etaoin"), b" " * byte_bpe.LONG]
    merges = byte_bpe._merges(path)
    cells = merges.cells(pieces)
    rows = spark.createDataFrame([(cells[:300].to_pylist(),), (cells[300:].to_pylist(),), ([],)], "cells array<array<bigint>>").coalesce(1)
    got = [r["c"] for r in rows.select(byte_bpe.merge_pieces(F.col("cells"), path).alias("c")).collect()]
    assert [len(g) for g in got] == [300, len(pieces) - 300, 0]
    ids = byte_bpe.ids_of(pa.array([c for g in got for c in g], pa.list_(pa.int64()))).to_pylist()
    assert ids == [lib._core_bpe.encode_single_piece(p) for p in pieces]
    assert byte_bpe.ids_of(merges.cells([])).to_pylist() == [] and byte_bpe.ids_of(merges.cells([b""])).to_pylist() == [[]]
    with pytest.raises(ValueError):
        byte_bpe.Merges({bytes([i]): i for i in range(256)} | {b"ab": 1 << byte_bpe.SYMBOL})

    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(12))
    new = docs(spark, [" ".join(word() for _ in range(2_000)) for _ in range(40)]).coalesce(1).withColumnRenamed("doc_id", "id")
    held = lambda x: types.SimpleNamespace(value=x)
    sizes = [r["n"] for r in byte_bpe.chunks(new, P.PATTERN, held([]), held(ranks), held(merges)).select(F.size("cells").alias("n")).collect()]
    assert sum(sizes) > 79_000 and max(sizes) < byte_bpe.NEW + byte_bpe.READ // 12


def test_words_after_spaces():
    """Only a space with white space or an end of the text on both sides keeps a text whole."""
    from raggedlake.llm.text import spaced_words

    for whole in ("a   b", " ", "a \n \x85b", "  a", "a  "):
        assert spaced_words(whole) == (whole, [])
    assert spaced_words("a b\nc  d") == ("a", ["b\nc", "", "d"]) and spaced_words("a\n b") == ("a\n", ["b"])
    assert spaced_words("") == ("", []) and spaced_words(" a") == ("", ["a"]) and spaced_words("a ") == ("a", [""])


def test_pieces_are_appended_in_place():
    """Small additions don't copy what a task holds, and leave the shared arrays as they were."""
    import pyarrow as pa

    size, flat = np.ones(8_000, np.int32), np.arange(8_000, dtype=np.int32)
    have, moved = byte_bpe.Pieces(size, flat), 0
    for k in range(100):
        before = have.flat
        have.add(pa.array([[k, k], [7]], pa.list_(pa.int32())), 0)
        moved += not np.shares_memory(before, have.flat)
    assert moved < 3 and len(flat) == 8_000 and have.text(np.array([0, 8_000, 8_001, 8_198])).tolist() == [0, 0, 0, 7, 99, 99]
