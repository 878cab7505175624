"""Benchmark decontamination by CGK embedding and bit sampling.

The CGK embedding reads a window with a random walk: at each step it writes the current word and moves on
or stays, as a coin drawn from the step and the word says.  Windows at a small edit distance fall into
step again after each edit, so their embeddings differ in few places, and keys of a few sampled places
meet.  Walks from all windows are taken at once: two walks that reach one word at one step stay together
from then on, so after SKIP steps few are left, and only what follows is sampled.  Items are walked from
all their words too, so a match needs no edit-free start.  Each of REPEATS repetitions draws new coins and
places; items of under WALK_WORDS words are found by parts instead (with e edits, one of e + 1 parts is
intact).  Every pair that meets is verified by the exact edit distance, in words, between the item and the
nearest stretch of the text.

The benchmark is broadcast in blocks of bounded size, so texts are never shuffled and a passage found in
a third of all documents is no hot key.

Defined cases: words are runs of letters and digits, lower-cased; null and empty texts and items match
nothing; repeated rows are reported each; equal items are reported each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import ship, table

from .text import BARE, Words, hash_spans, mix, odd_constants, pieces, raw, window_hash, words

NAME = "op7_benchmark_decontamination"
ORACLE_SQL = None

SIMILARITY = 0.8
#: Steps walked before sampling, steps sampled from, places sampled, repetitions.
SKIP, STEPS, PLACES, REPEATS = 3, 18, 8, 6
#: Items of fewer words are found by parts, none is missed; their walks would leave too few keys.
WALK_WORDS = 30
#: Characters of benchmark text in one broadcast block, about.
BLOCK_CHARS = 16_000_000


def bare_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    w = words(*raw(pc.utf8_lower(pc.fill_null(texts, ""))), inside=BARE)
    return w, hash_spans(w.data, w.start, w.end)


def walk_keys(h: np.ndarray, first: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key): words reached after SKIP steps by walks from all words, and the key of what follows."""
    n = len(h)
    end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    places = np.random.default_rng(repeat).permutation(STEPS)[:PLACES]
    weights = odd_constants(STEPS, 1000 + repeat)
    start = key = None
    for step in range(SKIP + STEPS):
        salt = odd_constants(1, 7919 * (repeat + 1) + step)
        if step == SKIP:
            start, key = at, np.zeros(len(at), np.uint64)
            limit = end[at]
        word = h[at]
        if step >= SKIP and step - SKIP in places:
            key += word * weights[step - SKIP]
        # The top bit of a product is as good a coin as any, and cheap.
        move = word * salt >> np.uint64(63)
        at = at + move.astype(np.int64)
        if step < SKIP:
            inside = at < np.append(end, n)[at - move.astype(np.int64)]
            at = at[inside]
            apart = np.ones(len(at), bool)
            apart[1:] = at[1:] != at[:-1]
            at = at[apart]
        else:
            inside = at < limit
            if not inside.all():
                at, start, key, limit = at[inside], start[inside], key[inside], limit[inside]
    return start, mix(key)


def _reach(item: np.ndarray, region: np.ndarray, free_start: bool) -> np.ndarray:
    """Edit distance between the item and the region's stretch ending at each place, from anywhere or from its start."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64) if free_start else steps.copy()
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (region != np.uint64(word)), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return row


def nearest(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, low, high) of the stretch of the region nearest to the item."""
    ends = _reach(item, region, True)
    high = int(ends.argmin())
    back = _reach(item[::-1], region[:high][::-1], False)
    return int(ends[high]), high - int(back.argmin()), high


@dataclass
class Index:
    """Keys of a block of items, and where in which item each lies."""

    ids: list
    words: list[np.ndarray]
    edits: list[int]
    walks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # key, item, place
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length


def build(ids: list, texts: list, similarity: float = SIMILARITY) -> Index:
    w, h = bare_words(pa.array(texts, pa.large_string()))
    own = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    index = Index(ids, own, [int((1 - similarity) * len(x) + 1e-9) for x in own])
    long = w.counts >= WALK_WORDS
    for repeat in range(REPEATS):
        place, key = walk_keys(h, w.first, repeat)
        item = w.doc[place]
        key, item, place = key[long[item]], item[long[item]], (place - w.first[item])[long[item]]
        order = np.argsort(key)
        index.walks.append((key[order], item[order], place[order]))
    parts: dict[int, list] = {}
    for item in np.flatnonzero(~long & (w.counts > 0)):
        cuts = np.linspace(0, len(own[item]), index.edits[item] + 2).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            parts.setdefault(int(b - a), []).append((window_hash(own[item][a:b], int(b - a), 3)[0], item, a))
    for size, rows in parts.items():
        key, item, place = (np.array(c) for c in zip(*sorted(rows)))
        index.parts[size] = key.astype(np.uint64), item, place
    return index


def _meet(keys: np.ndarray, place: np.ndarray, entry: tuple[np.ndarray, np.ndarray, np.ndarray], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text place, item, item place) of equal keys."""
    known, item, at = entry
    maybe = np.flatnonzero(bitmap[(keys & np.uint64(len(bitmap) - 1)).astype(np.int64)])
    keys, place = keys[maybe], place[maybe]
    low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, side="right")
    n = high - low
    which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(place, n), item[which], at[which]


def _bitmap(keys: np.ndarray) -> np.ndarray:
    found = np.zeros(1 << max(12, int(16 * len(keys)).bit_length()), bool)
    found[(keys & np.uint64(len(found) - 1)).astype(np.int64)] = True
    return found


class Finder:
    def __init__(self, index: Index) -> None:
        self.index = index
        self.walk_maps = [_bitmap(k) for k, _, _ in index.walks]
        self.part_maps = {size: _bitmap(e[0]) for size, e in index.parts.items()}

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, low, high), words low to high; the nearest stretch for each row and item."""
        index = self.index
        w, h = bare_words(texts)
        met = [_meet(*walk_keys(h, w.first, r)[::-1], index.walks[r], self.walk_maps[r]) for r in range(REPEATS) if len(index.walks[r][0])]
        for size, entry in index.parts.items():
            keys = window_hash(h, size, 3)
            met.append(_meet(keys, np.arange(len(keys)), entry, self.part_maps[size]))
        if not met:
            return []
        place, item, at = (np.concatenate(c) for c in zip(*met))
        row = np.searchsorted(w.first, place, side="right") - 1
        # Where the item would begin; one candidate for all that begin within its allowance of edits.
        begin = place - at
        width = np.array([e + 1 for e in index.edits], np.int64)[item] if len(item) else item
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, i, b in sorted(set(zip(row.tolist(), item.tolist(), (begin // width * width).tolist()))):
            own, e = index.words[i], index.edits[i]
            low, high = max(int(w.first[r]), b - e), min(int(w.first[r + 1]), b + len(own) + 2 * e + 1)
            distance, x, y = nearest(own, h[low:high])
            if distance <= e and (r, i) not in found or (r, i) in found and distance < found[r, i][0]:
                base = low - int(w.first[r])
                found[r, i] = distance, base + x, base + y
        return [(r, i, *v) for (r, i), v in sorted(found.items())]


#: The finder of the block last used in this worker.
_FINDERS: dict[int, Finder] = {}


def _finder(index: Index) -> Finder:
    if id(index) not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[id(index)] = Finder(index)
    return _FINDERS[id(index)]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes over the whole benchmark, each over items of about block_chars characters."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        if rows:
            yield build([r.item_id for r in rows], [r.text for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, similarity, low, high: items found in documents, and where (by word)."""
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, distance long, similarity double, low long, high long"
    found = spark.createDataFrame([], schema)
    for index in blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            finder = _finder(held.value)
            for batch in batches:
                for part in pieces(batch, "text"):
                    hits = finder.find(part.column("text"))
                    ids = part.column("doc_id").to_pylist()
                    own = finder.index
                    rows = [(ids[r], own.ids[i], d, 1 - d / len(own.words[i]), a, b) for r, i, d, a, b in hits]
                    columns = list(zip(*rows)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 3 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "item_id", "distance", "similarity", "low", "high"])

        found = found.unionByName(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    for index in blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            finder = _finder(held.value)
            for batch in batches:
                for part in pieces(batch, "text"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r for r, *_ in finder.find(part.column("text"))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))
