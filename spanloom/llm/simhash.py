"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint is cut into segments of 22, 21 and 21 bits.  Where two fingerprints differ in at most four
bits, the two segments with the fewest errors have at most two between them: (0, up to 2) or (1, 1).
The perfect binary Golay code of length 23 turns such errors into equal keys: ``near`` keys of a segment
are the codeword indices of all words within one bit of it.  Segments up to two bits apart share a near
key, and the ``own`` index of a segment is a near key of every segment within one bit.  So pairs meet on
  - one segment equal and a shared near key of another (six ordered choices), or
  - own index of one segment among the other's near keys, the reverse on a second (three choices), and one of
    three parts of the third equal, which then has one or two errors.  That makes these keys 31 bits long, so
    that the number of unlike fingerprints that meet stays small.
Every pair that meets is verified by counting differing bits, within the join, and only fingerprints that
differ take part: equal ones are one class from the start.

Defined cases: null and empty texts have fingerprint zero; short texts have one shingle, the whole
sequence; repeated rows share fingerprint and component; a null doc_id never names a component; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import cut, maybe_broadcast, release, ship, table

from .components import components, join_facts
from .text import LOWER, SPACE, pieces, raw, words

NAME = "op6_simhash_near_dedup"
ORACLE_SQL = None

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42

# ---------------------------------------------------------------- fingerprints


def shingle_hashes(data: bytes, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every k-word shingle (fewer words: the whole sequence), and how many each text has."""
    data = data.translate(LOWER)
    w = words(data, offsets)
    n = w.counts
    per_doc = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    total = int(per_doc.sum())
    if not total:
        return np.zeros(0, np.uint64), per_doc
    # Squeeze white space to one space after each word, so that a shingle is one slice.
    buf = np.frombuffer(data, np.uint8)
    space = SPACE[buf]
    keep = ~space
    tail = w.end[w.end < len(buf)]
    keep[tail[space[tail]]] = True
    place = np.cumsum(keep)
    line = np.where(space, 0x20, buf)[keep].tobytes()
    start, end = place[w.start] - 1, place[w.end - 1]
    head = np.repeat(w.first[:-1], per_doc) + np.arange(total) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    last = head + np.repeat(np.minimum(n, k), per_doc) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(start[head].tolist(), end[last].tolist())), np.uint64, total), per_doc


_LANES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Per text the 64-bit word of the bits that are set in over half of its hashes."""
    out = np.zeros(len(per_doc), np.uint64)
    full = np.flatnonzero(per_doc)
    if not len(full):
        return out
    m = per_doc[full]
    at = np.cumsum(m) - m
    # Eight bits of each byte lane add up to at most 255, so sum runs of 255 hashes lane by lane.
    runs = -(-m // 255)
    run_of = np.cumsum(runs) - runs
    starts = np.repeat(at - run_of * 255, runs) + np.arange(runs.sum()) * 255
    for bit in range(8):
        lanes = np.add.reduceat(h >> np.uint64(bit) & _LANES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_of, axis=0)
        for lane in range(8):
            out[full] |= (2 * sums[:, lane] > m).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = majority(*shingle_hashes(*raw(part.column("text")), k))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- Golay keys

#: Fixed value: generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101
#: (shift, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _syndromes(words23: np.ndarray) -> np.ndarray:
    rest = words23.copy()
    for bit in range(22, 10, -1):
        rest ^= (rest >> bit & 1) * (GENERATOR << bit - 11)
    return rest


def _leaders() -> np.ndarray:
    """The error pattern of weight three or less for each syndrome; the code is perfect, so it is unique."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one[None, :])[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | one[None, :]).ravel())
    three = three[np.bitwise_count(three) == 3]
    errors = np.concatenate([[0], one, two, three]).astype(np.int64)
    table_ = np.zeros(2048, np.int64)
    table_[_syndromes(errors)] = errors
    return table_


class Golay:
    def __init__(self) -> None:
        self.leaders = _leaders()

    def own(self, segment: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword nearest to each word."""
        return (segment ^ self.leaders[_syndromes(segment)]) >> 11

    def near(self, segment: np.ndarray, bits: int) -> np.ndarray:
        """Indices for every word within one bit, a row each; repeats within a row are -1."""
        around = segment[:, None] ^ np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int64)[None, :]
        found = np.sort(self.own(around.ravel()).reshape(around.shape), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def keys_of(fp: np.ndarray, golay: Golay, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of one side of the join."""
    u = fp.view(np.uint64)
    seg = [(u >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    own, near = [golay.own(x) for x in seg], [golay.near(x, b) for x, (_, b) in zip(seg, SEGMENTS)]
    rows, keys = [], []
    for kind, (a, b) in enumerate(permutations(range(3), 2)):
        r, c = np.nonzero(near[b] >= 0)
        rows.append(r)
        keys.append(kind << 40 | seg[a][r] << 12 | near[b][r, c])
    for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)), 6):
        one, many, third = (a, b, 3 - a - b) if left else (b, a, 3 - a - b)
        r, c = np.nonzero(near[many] >= 0)
        first, second = (own[one][r], near[many][r, c]) if left else (near[many][r, c], own[one][r])
        both = kind << 40 | first << 24 | second << 12
        # Of the third segment, with two errors at most, one of three parts is intact.
        for part in range(3):
            rows.append(r)
            keys.append(both | part << 9 | (seg[third][r] >> 7 * part) & (0xFF if part == 2 else 0x7F))
    return np.concatenate(rows), np.concatenate(keys)


def _side(fps: DataFrame, left: bool) -> DataFrame:
    name = "a" if left else "b"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fp, root = (c.slice(at, 2048).to_numpy(zero_copy_only=False) for c in batch.columns)
                row, key = keys_of(fp, golay, left)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(root[row])], ["key", name, f"{name}_root"])

    return fps.select("fp", "root").mapInArrow(run, f"key long, {name} long, {name}_root long")


def differing(a: Column, b: Column, segment: tuple[int, int] = (0, 64)) -> Column:
    shift, bits = segment
    mask = ((1 << bits) - 1) << shift
    both = a.bitwiseXOR(b)
    return F.bit_count(both if bits == 64 else both.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)))


def meeting_kind(a: Column, b: Column) -> Column:
    """The one kind of key at which a pair within four bits is reported, of all at which it may meet."""
    e = [differing(a, b, s) for s in SEGMENTS]
    kind = F.lit(8)
    for k, (i, j) in reversed([*enumerate(permutations(range(3), 2)), (6, (0, 1)), (7, (0, 2))]):
        kind = F.when((e[i] == 0) & (e[j] <= 2) if k < 6 else (e[i] <= 1) & (e[j] <= 1), k).otherwise(kind)
    return kind


def stars(fps: DataFrame) -> DataFrame:
    """Some of the links: from the members of each key's group to its least member.  One row a member."""
    keys = _side(fps, True).where(F.shiftright("key", 40) < 6)
    heads = keys.groupBy("key").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = keys.join(heads, "key").where((F.col("a") != F.col("b")) & (differing(F.col("a"), F.col("b")) <= MAX_BITS))
    return met.select("a", "b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp with the root it is known to belong to.  The pairs of them within four bits that
    join different roots."""
    left, right = _side(fps, True), _side(fps, False)
    near = differing(left.a, right.b) <= MAX_BITS
    met = left.join(right, (left.key == right.key) & (left.a < right.b) & (left.a_root != right.b_root) & near & (meeting_kind(left.a, right.b) == F.shiftright(left.key, 40)))
    return met.select("a", "b").distinct()


def with_roots(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """fps with root: its component's, or itself."""
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    ship(docs.sparkSession)
    prints = cut(fingerprints(docs, k))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    # Star links first: large groups of near copies become one component before pairs are looked for,
    # and the exact search reports only pairs between different components.
    some = cut(stars(classes.withColumn("root", F.col("fp"))))
    rest = cut(links(with_roots(classes, components(some))))
    named = cut(with_roots(classes, components(some.unionByName(rest))))
    # The component's name is the least doc_id over its fingerprints.
    names = cut(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    of_class = join_facts(named, names, "root", "members").select("fp", "copies", "component_id")
    return join_facts(prints, cut(of_class), "fp", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id.  Links are those within four bits and the
    near copies of ``similar``, among all different texts; groups are what both link together.  Of repeated rows
    one stays, too, and documents with a null id all stay; an empty table gives an empty result."""
    from .similar import similar_links

    found = cut(near_duplicates(docs).where("doc_id IS NOT NULL").select("doc_id", "component_id"))
    release(spark)
    known = found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    groups = components(known.unionByName(similar_links(docs)))
    gone = cut(groups.where("node <> root").select(F.col("node").alias("doc_id")))
    again = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").join(gone, "doc_id", "left_anti"))
    n_again = again.count()
    apart = gone.unionByName(again)
    kept = docs.join(maybe_broadcast(apart, gone.count() + n_again), "doc_id", "left_anti")
    if not n_again:
        return kept
    repeated = docs.join(again, "doc_id", "left_semi").withColumn("same", F.xxhash64(F.coalesce("text", F.lit(""))))
    return kept.unionByName(repeated.dropDuplicates(["doc_id", "same"]).drop("same"))
