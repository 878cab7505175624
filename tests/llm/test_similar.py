"""Near copies beyond four bits, against brute force on whole shingle sets."""

import random
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import similar
from test_pipeline import likeness, shingles


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))


def edited(rng, w, n):
    w = list(w)
    for k in rng.sample(range(len(w)), n):
        w[k] = word(rng)
    return w


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def groups(texts):
    """doc_id: least id of its group, for texts with near copies."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if likeness(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {i: r for i, r in enumerate(root) if root.count(r) > 1}


def found(spark, texts):
    docs = frame(spark, texts)
    return {r.doc_id: r.root for r in similar.near_copies(docs, docs.select("doc_id")).collect()}


@pytest.fixture(scope="module")
def crowd():
    """Texts with one long passage in common, which are no near copies, and before them a stranger that has it too."""
    rng = random.Random(3)
    passage = [word(rng) for _ in range(150)]
    texts = [passage + [word(rng) for _ in range(40)] for _ in range(60)]
    texts += [edited(rng, w, 4) for w in texts[20:]]
    return [" ".join(w) for w in texts]


def test_all_members_of_a_crowded_key_are_compared(spark, crowd):
    want = groups(crowd)
    assert len(want) >= 40 and 0 not in want
    assert found(spark, crowd) == want


def test_threshold_is_exact(spark):
    rng = random.Random(4)
    texts = []
    for i in range(120):
        w = [word(rng) for _ in range(rng.randrange(100, 400))]
        texts += [" ".join(w), " ".join(edited(rng, w, round(len(w) * rng.uniform(0.018, 0.04))))]
    alike = [likeness(shingles(a), shingles(b)) for a, b in zip(texts[::2], texts[1::2])]
    assert sum(0.7 <= x < 0.8 for x in alike) >= 20 and sum(0.8 <= x < 0.85 for x in alike) >= 20
    assert found(spark, texts) == groups(texts)


def test_links_do_not_depend_on_size(spark, crowd, monkeypatch):
    """The settings that follow the number of rows change the cost only."""
    monkeypatch.setattr(similar, "EXACT_ROWS", 1, raising=False)
    monkeypatch.setattr(similar, "SAMPLE_ROWS", 10, raising=False)
    assert found(spark, crowd) == groups(crowd)


@pytest.mark.parametrize("parts, full", [(1, 1 << 21), (4, 1 << 21), (4, 4_000), (50, 1 << 21)])
def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch, parts, full):
    """Phrases that the least number of texts hold, or a few more or less, together, scattered, or in part both."""
    n, least = 41_000, 82
    texts = [f"alone{i}" for i in range(n)]
    free = list(range(n))
    for k, (times, together) in enumerate((t, share) for t in range(least - 4, least + 5) for share in (0, 0.5, 0.9, 0.95, 1)):
        run = round(times * together)
        at = [free.pop(k * 100) for _ in range(run)] + [free.pop(j * (len(free) // 90)) for j in range(times - run)]
        for i in at:
            texts[i] = f"some phrase of number p{k}"
    want = sorted(t for t, times in Counter(texts).items() if times >= least)
    assert len(want) == 25 and len(set(texts)) > n - 5_000
    monkeypatch.setattr(similar, "HELD", full, raising=False)
    docs = spark.sparkContext.parallelize(list(enumerate(texts)), parts).toDF("doc_id long, text string")
    assert docs.rdd.getNumPartitions() == parts
    hashes = np.concatenate([similar.shingle_sets(t.encode(), np.array([0, len(t)]), np.zeros(0, np.uint64))[1] for t in want])
    assert similar.common_shingles(docs, n).tolist() == sorted(hashes.tolist())


@pytest.mark.parametrize("parts, full, rows", [(50, 1 << 21, 10_000), (1, 1, 9_900)])
def test_counting_common_shingles_hands_over_few_rows(spark, monkeypatch, parts, full, rows):
    """Rows that leave Python while common shingles are counted: no text's own shingles are among them, however few
    texts a task has, or has left over."""
    n, least = 20_000, 40
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    docs = spark.sparkContext.parallelize(range(n), parts).map(lambda i: (i, own(i) if i % 400 else "the same phrase of all")).toDF("doc_id long, text string")
    monkeypatch.setattr(similar, "HELD", full)
    made, plain = spark.sparkContext.accumulator(0), type(docs).mapInArrow

    def counting(df, run, schema, *more, **named):
        def told(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return plain(df, told, schema, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", counting)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        common = similar.common_shingles(docs, n)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(common) == 1 and n // 400 >= least
    assert 0 < made.value < 2_000


def test_common_shingles_of_crowded_counters(spark, crowd, monkeypatch):
    """With as few counters as there can be, all are reached and every shingle is counted; the result is the same."""
    monkeypatch.setattr(similar, "MOST_COUNTERS", similar.PANEL)
    texts = [" ".join([t] + [f"{t[:40]}{k}" for k in range(2_000)]) for t in crowd]
    held = Counter(h for t in texts for h in similar.shingle_sets(t.encode(), np.array([0, len(t.encode())]), np.zeros(0, np.uint64))[1].tolist())
    want = sorted(h for h, times in held.items() if times >= similar.COMMON_LEAST)
    assert similar._reached(similar._texts(frame(spark, texts)), similar.COMMON_LEAST, similar.PANEL).all()
    assert want and similar.common_shingles(frame(spark, texts), len(texts)).tolist() == want


def test_cells_of_a_key_meet_every_pair_once(spark):
    """Every pair of different roots of a key is met, once, however the members are dealt."""
    rows = [(k, a, 9, 0, 0, 0, a // 2 * 2, blocks) for k, members, blocks in ((1, 40, 7), (2, 9, 1), (3, 2, 2), (4, 1, 1)) for a in range(members)]
    frame_ = spark.createDataFrame(rows, "key long, a long, n int, at int, s1 long, s2 long, root long, blocks int")
    got = sorted((r.a, r.b) for r in similar.pairs_of_keys(frame_).collect())
    want = sorted((a, b) for members in (40, 9, 2) for b in range(members) for a in range(b) if a // 2 != b // 2)
    assert got == want


def test_dealt_keys_lose_no_link(spark, crowd, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 5)
    assert found(spark, crowd) == groups(crowd)


def test_short_repeated_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "A  b c"), (3, "a b"), (4, ""), (5, None), (None, "a b c"), (6, "a b"), (6, "x y z")], "doc_id long, text string")
    got = {r.doc_id: r.root for r in similar.near_copies(docs, docs.select("doc_id")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 6: 3}
    assert similar.near_copies(docs.limit(0), docs.select("doc_id").limit(0)).count() == 0
