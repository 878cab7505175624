"""The pipeline's stages on the odd corpus, each against brute force on its own input."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from test_queries import WORD, classes, kept_words, leaks, simhash_of


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output folders of every stage."""
    root = tmp_path_factory.mktemp("stages")
    where, out = f"{sf_dir}/documents.parquet", []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, spark.read.parquet(where), sf_dir).write.parquet(f"{root}/{name}/documents.parquet")
        out.append((where, f"{root}/{name}/documents.parquet"))
        where = out[-1][1]
    return out


def read(spark, where):
    return [(r.doc_id, r.text) for r in spark.read.parquet(where).collect()]


def test_columns(spark, stages):
    for _, after in stages[:-1]:
        assert spark.read.parquet(after).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_drops_what_has_no_letter(spark, stages):
    before, after = (read(spark, w) for w in stages[0])
    assert sorted(after) == sorted(r for r in before if re.search(r"[^\W\d_]", r[1] or ""))


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def test_near_dedup_keeps_one_of_each_group(spark, stages):
    before, after = (read(spark, w) for w in stages[1])
    prints = {i: simhash_of(t) for i, t in before}
    name = classes(prints)
    named = {i: t for i, t in before if name[prints[i]] == i}
    kept = dict(after)
    assert len(kept) == len(after) and kept.items() <= named.items()
    # The groups of both kinds of links together, by brute force over all texts.
    rows = [(i, t, shingles(t) if WORD.search(t or "") else None) for i, t in before]
    root = {i: name[prints[i]] for i, _ in before}
    for i, _, a in rows:
        for j, _, b in rows:
            if i < j and a and b and likeness(a, b) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert kept.keys() == set(root.values())


def test_near_copies_of_a_copy_are_joined(spark):
    """A and B are within four bits, B and C overlap by 0.8, A and C by less: one group."""
    from spanloom.llm.simhash import fingerprints, stage

    rng = random.Random(8)
    for _ in range(400):
        a = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
        b, c = list(a), list(a)
        b[0], c[0], c[36] = "x", "x", "y"
        texts = [" ".join(x) for x in (a, b, c)]
        sets = [shingles(t) for t in texts]
        if (simhash_of(texts[0]) ^ simhash_of(texts[1])).bit_count() <= 4 and likeness(sets[1], sets[2]) >= 0.8 > likeness(sets[0], sets[2]):
            break
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert fingerprints(docs).count() == 3
    assert [r.doc_id for r in stage(spark, docs, "").collect()] == [0]


def test_near_copies_are_found_and_others_left(spark):
    from spanloom.llm.simhash import stage

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    rows, copies = [], 0
    for i in range(150):
        w = [word() for _ in range(rng.randrange(120, 500))]
        rows.append((len(rows), " ".join(w)))
        if i % 3 == 0:
            for k in rng.sample(range(len(w)), len(w) // 60):
                w[k] = word()
            copies += likeness(shingles(rows[-1][1]), shingles(" ".join(w))) >= 0.8
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in stage(spark, docs, "").collect()}
    originals = {i for i, t in rows if not any(likeness(shingles(t), shingles(u)) >= 0.8 for _, u in rows[max(0, i - 1) : i])}
    assert copies >= 45 and left == originals


def test_substring_stage_cuts_repeats(spark, stages):
    before, after = (read(spark, w) for w in stages[2])
    want = {i: [x for x, g in zip(w, gone) if not g] for i, w, gone in kept_words(before)}
    assert {i: WORD.findall(t) for i, t in after} == {i: w for i, w in want.items() if w}


def test_decontamination_drops_leaks_only(spark, stages, sf_dir, tmp_path_factory):
    before, after = (read(spark, w) for w in stages[3])
    root = tmp_path_factory.mktemp("leaks")
    spark.read.parquet(stages[3][0]).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
    gone = {i for i, *_ in leaks(spark, str(root))}
    assert sorted(after) == sorted(r for r in before if r[0] not in gone)


def test_mix_covers_all_that_is_left(spark, stages):
    before, after = stages[4]
    rows = spark.read.parquet(after).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in read(spark, before))
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=20)


def test_run_and_empty(spark, sf_dir, empty_dir, stages):
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got == sorted(map(tuple, spark.read.parquet(stages[-1][1]).collect()))
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
