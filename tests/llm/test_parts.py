"""The operators' own parts: codes, parses, segments, paths, indexes, and their general interfaces."""

import itertools
import math
import random
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import benchmarks, components, languages, licenses, recompress, simhash, sketches, substrings, text, tokens, toxicity, urls
from spanloom.runtime import table


def test_words_on_odd_texts():
    texts = ["a b", None, "", " x\t\x0by ", "é z"]
    w = text.words(*text.raw(pa.array(texts)))
    assert [w.data[a:b].decode() for a, b in zip(w.start, w.end)] == ["a", "b", "x", "y", "é z"]
    assert w.counts.tolist() == [2, 0, 0, 2, 1]


def test_equal_words_hash_alike_wherever_they_are():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    w = text.words(*text.raw(pa.array([" ".join(words), " " + "  ".join(words)])))
    h = text.hash_spans(w.data, w.start, w.end)
    assert (h[:500] == h[500:]).all() and len(set(h.tolist())) == len(set(words))


def test_pieces_cover_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 100, 3, 0, 7)]})
    assert [r for p in text.pieces(batch, "text", 8) for r in p.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_words_that_differ_by_control_bytes_are_told_apart(spark):
    tail = " ".join(f"w{k}" for k in range(12))
    heads = ["a", "b\x00", "c\x00\x00", "\x00", "\x00\x00", "a\x01", "a\x1f", "c\x02\x00"]
    docs = spark.createDataFrame([(k, f"{h} {tail}") for k, h in enumerate(heads)] + [(90, f"a {tail}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.without_repeats(docs).collect()}
    assert got == {**dict.fromkeys(range(len(heads)), 0), 90: 13}
    w = text.words(*text.raw(pa.array([" ".join(heads)])))
    for seed in (0, 1, 12345):
        assert len(set(text.hash_spans(w.data, w.start, w.end, seed).tolist())) == len(heads)


# ---------------------------------------------------------------- SimHash


def test_golay_code_is_perfect():
    golay = simhash.Golay()
    assert len(set(golay.leaders.tolist())) == 2048
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 300)
    own = golay.own(x)
    near = golay.near(x, 23)
    assert all(o in row for o, row in zip(own, near))
    # Words two bits apart share a near index.
    for a, row in zip(x, near):
        i, j = rng.choice(23, 2, replace=False)
        other = golay.near(np.array([a ^ (1 << i) ^ (1 << j)]), 23)[0]
        assert set(row[row >= 0]) & set(other[other >= 0])


def test_every_pair_within_four_bits_meets():
    rng = np.random.default_rng(1)
    golay = simhash.Golay()
    x = rng.integers(0, 1 << 63, 400, dtype=np.int64)
    y = x.view(np.uint64).copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    keys = lambda v, left: (lambda r, k: [set(k[r == i].tolist()) for i in range(len(v))])(*simhash.keys_of(v, golay, left))
    for a, b in ((x, y.view(np.int64)), (y.view(np.int64), x)):
        assert all(p & q for p, q in zip(keys(a, True), keys(b, False)))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(k, k + 1) for k in range(100, 130)]
    parent = {x: x for e in links for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_large_group_of_near_fingerprints_gives_one_component(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    prints = {base} | {base ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 62, (400, 2))}
    fps = spark.createDataFrame([(f, f) for f in prints], "fp long, root long")
    known = components.components(simhash.stars(fps))
    rest = simhash.links(simhash.with_roots(fps.select("fp"), known))
    # The pairs left to report are few although nearly all pairs are links.
    assert rest.count() < len(prints)
    roots = components.components(simhash.stars(fps).unionByName(rest))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(prints)


# ---------------------------------------------------------------- recompression


@pytest.mark.parametrize("seed", range(20))
def test_equal_windows_have_equal_anchors(seed):
    rng = np.random.default_rng(seed)
    size, letters = 13, int(rng.integers(2, 40))
    shared = rng.integers(0, letters, 30)
    docs = [np.concatenate([rng.integers(0, letters, rng.integers(0, 20)), shared, rng.integers(0, letters, rng.integers(0, 20))]) for _ in range(6)] + [shared, np.zeros(40, int), np.zeros(25, int)]
    ids = np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    names = text.mix((ids + 1).astype(np.uint64))
    first = np.cumsum([0, *(len(d) for d in docs)])
    starts = recompress.window_starts(first, size)
    length = np.append(0, np.cumsum(1 + ids % 5))
    got = recompress.anchors(recompress.levels(names, doc), starts, size, length)
    by_window = {}
    for s, a in zip(starts, got):
        assert a != 0 and by_window.setdefault(tuple(ids[s : s + size]), a) == a


def test_cut_text_keeps_the_rest(spark):
    base = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, base, "x"), (2, f"  head\n\n{base}\ttail ", "y"), (3, base, "z"), (4, None, "n")], "doc_id long, text string, other string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text, r.other) for r in substrings.without_repeats(docs, with_text=True).collect()}
    assert got == {1: (30, 0, base, "x"), 2: (32, 30, "  head\n\ntail ", "y"), 3: (30, 30, "", "z"), 4: (0, 0, "", "n")}


# ---------------------------------------------------------------- toxicity, languages


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 25))
    at = np.flatnonzero(rng.random(n) < 0.35)
    gain = rng.random(len(at)) * 3 + 0.4
    s = np.full(n, -0.37)
    s[at] += gain
    out = []

    def split(a, b):
        best, where = 1e-12, None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                if s[i:j].sum() > best + 1e-12:
                    best, where = s[i:j].sum(), (i, j)
        if where:
            split(a, where[0])
            out.append((*where, best))
            split(where[1], b)

    split(0, n)
    got = toxicity.maximal_segments(s)
    assert [x[:2] for x in got] == [x[:2] for x in out] and np.allclose([x[2] for x in got], [x[2] for x in out])


def test_passages_are_reported(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, passages=True).where("size(passages) > 0")
    assert found.count() > 10
    for r in found.collect():
        for p in r.passages:
            assert p.low < p.high and p.e_value < toxicity.SIGNIFICANT and len(p.passage.split()) >= 1


def test_without_labels_nothing_is_toxic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").limit(0))
    assert toxicity.score(docs, model).where("score >= 0.5").count() == 0


def test_best_path_is_best():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = int(rng.integers(1, 6))
        s = rng.normal(size=(n, 3)) * rng.choice([2, 20])
        value = lambda q: sum(s[i, k] for i, k in enumerate(q)) - languages.PENALTY * sum(a != b for a, b in zip(q, q[1:]))  # noqa: E731, B023
        assert abs(value(languages.best_path(s)) - max(value(q) for q in itertools.product(range(3), repeat=n))) < 1e-9


def test_spans_of_mixed_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languages.fit(docs)
    en, de = "the people would think that these things which they could see there", "durch die straße werden nicht schön über das haben eine sich auf"
    mixed = spark.createDataFrame([(1, f"{en} {en}. {de} {de}!")], "doc_id long, text string")
    row = languages.label(mixed, model, spans=True).head()
    assert [s.lang for s in row.spans] == ["en", "de"] and row.spans[1].low >= len(en)
    assert languages.label(mixed, languages.Model()).head().lang_pred == "und"


def test_short_texts_within_long_ones_are_found():
    rng = random.Random(11)
    found = []
    for _ in range(200):
        words = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
        at = rng.randrange(2900)
        part, whole = sketches.sketches(pa.array([" ".join(words[at : at + 30]), " ".join(words)]))
        found.append(sketches.containment(part, whole))
    assert min(found) > 0 and sum(found) / 200 > 0.99


def test_buckets_follow_the_order_of_pairs():
    rng = np.random.default_rng(3)
    pairs = sorted((int(a), int(b)) for a, b in zip(rng.integers(-3, 3, 60), rng.integers(-(1 << 63), 1 << 63, 60)))
    bounds = pairs[5::9]
    got = sketches.bucket_of(*(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)), tuple(np.array([c[k] for c in bounds], np.int64) for k in (0, 1)))
    assert got.tolist() == [sum(c <= p for c in bounds) for p in pairs]


@pytest.mark.parametrize("ids", [[-9 * 10**18, 9 * 10**18], [*range(50), 9 * 10**18], [hash(str(k)) * 7919 % (1 << 64) - (1 << 63) for k in range(60)], [7] * 30 + [8, None, None, -(1 << 63) + 1]])
def test_next_documents_at_any_ids(spark, ids):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randrange(0, 40))) + f" {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    ties = {r.text: r.tie for r in docs.collect()}
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]]))
    got = sorted(((r.doc_id, r.edited_sha256, r.near_next) for r in sketches.compare_edited(docs).collect()), key=repr)
    sets = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(t.split())
    want = []
    for (i, t), (_, u) in zip(line, line[1:] + line[:1]):
        a, b = sets(t), sets(u)
        want.append((i, sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest(), len(a & b) / min(len(a), len(b))))
    assert got == sorted(want, key=repr)


# ---------------------------------------------------------------- sketches, tokens, licences, URLs, benchmarks


def test_sketches_merge_and_compare_at_the_coarser_level():
    rng = random.Random(0)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    whole, half, part = sketches.sketches(pa.array([" ".join(words), " ".join(words[:2000]), " ".join(words[100:160])]))
    assert whole.limit == half.limit == sketches.LIMIT and part.limit == sketches.ALL and len(part.hashes) == 56
    assert sketches.containment(part, whole) == 1.0
    assert abs(sketches.containment(half, whole) - 1) < 1e-9
    assert sketches.sketches(pa.array(["", None]))[0].text() == f"{sketches.ALL:x}:"


def test_counts_do_not_depend_on_the_cache():
    path = tokens.tokenizer_path()
    small, large = tokens.Counter(path, {}, capacity=3), tokens.Counter(path, tokens.common_lengths(path, ["a", "b", "str", "0", ".", "abc"]))
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("abcXYZ'stre  \n\t09é ÉßıſŒ<|>endoftext.,!?§½²ªº­\u0085 İΣς漢字🙂́") for _ in range(rng.randrange(0, 40)))
        assert small.count(t) == large.count(t) == large.whole(t)


def test_mixed_scripts_count_as_the_library_counts():
    counter = tokens.Counter(tokens.tokenizer_path(), {}, capacity=50)
    rng = random.Random(6)
    words = ["“quoted”", "naïve", "it’s", "it's", "—", "привет", "漢字かな", "한글", "ΣΑΣ", "🙂🙂", "e\u0301", "\u0301x", "İx", "<|endoftext|>", "a<|endoftext|>b", "x\u00a0y", "x\u2003'll", "plain", "WORDS", "12½", "\u200b", "x\u0085y", "…"]
    for _ in range(400):
        t = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t ", "\x0b", ""]) for _ in range(rng.randrange(30)))
        assert counter.count(t) == counter.whole(t)


def test_frequent_pre_tokens_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(k, "alpha beta alpha " + chr(97 + k % 26) * (k // 26 + 1)) for k in range(200)] + [(999, None)], "doc_id long, text string").repartition(7)
    assert (tokens.frequent(docs, 3), tokens.frequent(docs, 5)) == (["alpha"], ["alpha", "beta"])
    assert {r.n_tokens for r in tokens.token_counts(docs).where("doc_id = 999").collect()} == {0}


def test_pages_keep_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 5, 6, 7, "h")], "page_id long, url string, bloom_bits int, found int, canon int, host string").withColumn("page", F.lit(8)).withColumn("possible", F.lit(9))
    row = urls.judge(pages, pages.select("url")).head()
    assert (row.bloom_bits, row.found, row.canon, row.page, row.possible) == (5, 6, 7, 8, 9) and (row.host, row.verdict, row.in_list) == ("a.net", "block", True)


def test_toxicity_against_brute_force(spark):
    """Fit and score again with plain dictionaries and loops."""
    rng = random.Random(9)
    clean, bad = [f"w{k}" for k in range(40)], ["vile", "foul", "mean"]
    rows = []
    for i in range(160):
        w = [rng.choice(clean) for _ in range(rng.randrange(4, 60))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    rows += [(200, rows[1][1], 1), (201, None, 0)]  # an equal text with another label; a null
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    label = {}
    for _, t, y in rows:
        label[t or ""] = max(y, label.get(t or "", 0))
    n = {0: {}, 1: {}}
    for t, y in label.items():
        for x in set(t.split()):
            n[y][x] = n[y].get(x, 0) + 1
    total = [sum(n[y].values()) for y in (0, 1)]
    score = {}
    for x in {*n[0], *n[1]}:
        c, prior, weight = [n[y].get(x, 0) for y in (0, 1)], toxicity.PRIOR * (n[0].get(x, 0) + n[1].get(x, 0)), toxicity.PRIOR * sum(total)
        odds = [math.log((c[y] + prior) / (total[y] + weight - c[y] - prior)) for y in (0, 1)]
        d, e = odds[1] - odds[0], toxicity.WIDTH * math.sqrt(1 / (c[1] + prior) + 1 / (c[0] + prior))
        least = d - e if d > e else d + e if d < -e else 0
        if least < -toxicity.LEAST_SCORE or c[1] > 1 and least > toxicity.LEAST_SCORE:
            score[x] = least
    w = text.words(*text.raw(pa.array([" ".join(sorted(score))])))
    names = dict(zip(sorted(score), text.hash_spans(w.data, w.start, w.end).tolist()))
    assert sorted(names.values()) == model.tokens.tolist()
    assert np.allclose([model.scores[model.tokens.tolist().index(names[x])] for x in score], list(score.values()))
    assert abs(sum((n[0].get(x, 0) + toxicity.PRIOR * (n[0].get(x, 0) + n[1].get(x, 0))) / (total[0] + toxicity.PRIOR * sum(total)) * (math.exp(model.rate * (s - model.drift)) - math.exp(-model.rate * model.drift)) for x, s in score.items()) + math.exp(-model.rate * model.drift) - 1) < 1e-6
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t, y in rows:
        w = (t or "").split()
        s = [score.get(x, 0) - model.drift for x in w]
        best = max((sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=-1)
        e = model.log_k + math.log(max(len(w), 1)) - model.rate * best
        if best <= 0:
            assert abs(found[i] - model.probability(np.array([-10.0]))[0]) < 1e-9
        elif e >= math.log(toxicity.SIGNIFICANT):
            assert abs(found[i] - model.probability(np.array([max(-e, -10.0)]))[0]) < 1e-9
        if t != rows[1][1]:
            assert (found[i] >= 0.5) == (y == 1)


def test_language_scores_against_brute_force(spark):
    """Counts, word scores and labels again with plain dictionaries."""
    rng = random.Random(10)
    words = {"aa": ["baba", "dada", "gaga", "papa"], "oo": ["boso", "toto", "nono", "wöwo"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randrange(1, 12))).title(), g) for i in range(60) for g in ("aa", "oo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.fit(docs)
    assert model.languages == ["aa", "oo"]

    def grams(word):
        b = b" " + word.encode() + b" "
        for k in range(1, len(b)):
            one, two = b[k - 1], b[k - 2] if k > 1 and b[k - 1] != 32 else 32
            yield "pair", one << 8 | b[k]
            yield "triple", ((two << 16 | one << 8 | b[k]) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - languages.TRIPLE_BITS

    counts = {g: {} for g in words}
    for _, t, g in rows:
        for x in t.lower().split():
            for key in grams(x):
                counts[g][key] = counts[g].get(key, 0) + 1
    room = {"pair": languages.PAIRS, "triple": 1 << languages.TRIPLE_BITS}
    total = {(g, kind): sum(v for (k, _), v in counts[g].items() if k == kind) + languages.SMOOTH * room[kind] for g in words for kind in room}
    tests = ["Baba toto nono.", "dada", "wöwo!", "xyz baba", "GAGA papa, papa toto toto toto nono nono boso boso boso"]
    w = languages.letters_only(pa.array(tests))
    got = languages.word_scores(w, model)
    flat = [x for t in tests for x in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    want = [[sum(math.log((counts[g].get(k, 0) + languages.SMOOTH) / total[g, k[0]]) for k in grams(x)) / 2 for g in model.languages] for x in flat]
    assert np.allclose(got, want, atol=1e-3)


def test_licence_tree(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    filler = " ".join(f"word{k}" for k in range(60))
    files = [("a/LICENSE", mit), ("a/x.py", filler), ("a/b/c/y.py", filler), ("a/b/LICENSE", gpl), ("a/b/z.py", f"{filler}\n{mit}"), ("q/n.py", None), ("a/b/c/d/e/w.py", "")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "row long, path string, text string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "file"), "a/x.py": ("MIT", "inherited"), "a/b/LICENSE": ("GPL-3.0", "file"), "a/b/c/y.py": ("GPL-3.0", "inherited"),
        "a/b/z.py": ("MIT", "header"), "q/n.py": (None, "none"), "a/b/c/d/e/w.py": ("GPL-3.0", "inherited"),
    }


def test_rows_with_one_id_are_judged_each(spark):
    docs = spark.createDataFrame([(7, "Released under the MIT License.", "en", "s"), (7, "nothing of the kind " * 9, "en", "t"), (None, "MIT License\n\nplain words", "en", "u")], "doc_id long, text string, lang string, source string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan(licenses.paths_of(docs)).collect()}
    assert got == {"s/en/0/7": ("MIT", "file"), "t/en/0/7": (None, "none"), "u/en/-/-": (None, "none")}


def test_whole_licences_headers_and_tags(spark):
    whole = {n: "Copyright (c) 2026 A. Writer\n\n" + t for n, k, t in licenses.TEMPLATES if k == "text"}
    apache = next(t for n, k, t in licenses.TEMPLATES if n == "Apache-2.0" and k == "notice" and "Unless" in t)
    lines = "\n".join("# " + " ".join(apache.split()[k : k + 9]) for k in range(0, len(apache.split()), 9))
    code = "\n".join(f"value_{k} = call_{k}(other_{k})" for k in range(200))
    files = {f"{n}/COPYING": (t, n, "file") for n, t in whole.items()}
    files["h/a.py"] = (f"#!/bin/python\n\n{lines}\n\n{code}", "Apache-2.0", "header")
    files["t/a.c"] = (f"/* SPDX-License-Identifier: MPL-2.0 */\n{code}", "MPL-2.0", "header")
    for name, n in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0")):
        where = Path("/usr/share/common-licenses") / name
        if where.exists():
            files[f"long/{name}/LICENSE"] = (where.read_text(), n, "file")
    files |= {f"code/{k}.py": (code.replace("_", f"_{k}"), None, "none") for k in range(20)}
    df = spark.createDataFrame([(p, t) for p, (t, _, _) in files.items()], "path string, text string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got == {p: (n, o) for p, (_, n, o) in files.items()}


def test_cover_drops_nothing_that_could_be_like_enough():
    rng = random.Random(4)
    idf = {f"t{k}": rng.uniform(1, 9) for k in range(30)}
    for _ in range(300):
        of = {t: idf[t] for t in rng.sample(sorted(idf), 8)}
        other = {t: idf[t] * rng.randrange(1, 3) for t in rng.sample(sorted(idf), 6)}
        cos = sum(of.get(t, 0) * w for t, w in other.items()) / math.sqrt(sum(w * w for w in of.values()) * sum(w * w for w in other.values()))
        assert cos < 0.7 or licenses.cover([of], 0.7, idf) & other.keys()


def test_list_is_exact_behind_the_filter(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h"), F.col("id").cast("string"), F.lit(".xyz/p/?utm_a=1")).alias("url"))
    listed = pages.where("page_id % 7 = 0").select(F.regexp_replace("url", "https://www", "http://m").alias("url"))
    got = urls.judge(pages, listed)
    assert got.where("in_list <> (page_id % 7 = 0)").count() == 0 and got.count() == 3000
    assert urls.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 0


def test_edited_items_are_found():
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 60))) for _ in range(60)]
    finder = benchmarks.Finder(benchmarks.build(list(range(60)), items))
    texts, want = [], []
    for _ in range(300):
        i = rng.randrange(60)
        w = items[i].split()
        for _ in range(int(0.2 * len(w))):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [f"z{rng.randrange(99)}"], [w[k], f"y{rng.randrange(99)}"]])
            w = w or ["z"]
        around = [rng.choice(vocabulary) for _ in range(200)]
        texts.append(" ".join(around[:100] + w + around[100:]))
        want.append(i)
    found = {(r, i) for r, i, *_ in finder.find(pa.array(texts))}
    assert sum((r, i) in found for r, i in enumerate(want)) >= 0.95 * len(want)
    clean = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(50)]
    assert not [i for _, i, *_ in finder.find(pa.array(clean)) if len(items[i].split()) > 8]


def test_blocks_of_the_benchmark_give_the_same(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    whole = {tuple(r) for r in benchmarks.leaks(docs, items).collect()}
    assert whole and whole == {tuple(r) for r in benchmarks.leaks(docs, items, block_chars=300).collect()}
