"""Near copies of lower similarity: texts whose five-word shingle sets overlap by 0.8 or more.

Texts whose five-word shingles overlap by 0.8 differ in six to ten of 64 SimHash bits, beyond what keys for
four bits can promise.  Here a text's distinct shingles are put into one order that all texts share: by hash,
and those that many of all texts hold last.  Of n shingles at most q = n // 5 can be missing from
such a partner, so a pair shares one of the first q + 1 of each.  The order among the rare and among the common
is random, so far fewer serve: of r > q rare shingles the first K all miss with a chance of at most
(q / r) ** K, which is held below MISS; with fewer rare ones, all of these and as many common ones as keep
that bound are keys.  For most texts that is 13 keys, whatever their length.

Every pair that shares a key is compared, whatever the size of the input: the key's places in both orders tell
how large the overlap can be at most, and a SimHash of 128 bits over the shingles, of which such a pair differs
in 19 on average with a deviation of 4, passes over pairs that differ in more than FAR (5.6 deviations; texts of
under FEW shingles are not judged by it).  What is left is verified by the whole sets.  So no link is wrong, and
a pair is lost with a chance of about 1e-8.

As in op6, stars come first: members of a key are compared with its least member.  Then the members of keys
that still hold several components are compared with each other inside the join, so a large group of near
copies is not paired out.  A key of many members is dealt over cells of at most BLOCK members of either side,
so its comparisons are shared among tasks and none holds the whole key.

The common shingles are held by at least one in 500 of all texts each, so there are at most 500 times the mean
number of shingles of a text of them; they only order the keys.  They are counted over all texts, in two passes.
The first adds up how often shingles fall on each of some counters, two for a shingle, with a table for each task;
no common shingle has a counter below the number of texts that makes one.  The second counts in how many texts the
shingles stand whose counters both reach that number, so all numbers are exact however the texts are dealt.  There
are as many counters as keep their mean at half that number or less, so few other shingles are counted, and a
task's rows are a table and what it holds of those.  Where texts are longer than 16 KB on average, the counters are
MOST_COUNTERS and their mean is higher: from about 100 KB on, most distinct shingles of a task are counted.

Defined cases: a text of fewer than five words has one shingle, the whole sequence; texts without words and
null ids take no part; repeated ids are one node; of equal texts the least id stands for all.  Shingles are
compared as 64-bit hashes, texts as 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import cut, maybe_broadcast, release, ship

from .components import components, join_facts
from .simhash import majority
from .text import LOWER, hash_spans, mix, odd_constants, pieces, raw, words

SHINGLE_WORDS = 5
#: The least Jaccard overlap of a link is PART / WHOLE.
PART, WHOLE = 4, 5
#: The chance at which either text of a pair may lose it.
MISS = 1e-9
#: The share (and number) of all texts that makes a shingle common.
COMMON_SHARE, COMMON_LEAST = 1 / 500, 8
#: The shingles of texts from which on a task hands over what it has counted.
HELD = 1 << 21
#: The least and the most counters, and how many of them make a row.
LEAST_COUNTERS, MOST_COUNTERS, PANEL = 1 << 14, 1 << 24, 1 << 14

#: The most of 128 bits in which a pair may differ, and the shingles from which that holds.
FAR, FEW = 42, 24

#: The most members of a key that one cell of its comparisons holds of either side, on average.
BLOCK = 1_000

#: Bytes of text that are worked on at once.
PIECE = 1 << 19

_NONE = np.zeros(0, np.uint64)


def shingles_of(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of all texts' shingles as they stand, repeats included."""
    data = data.translate(LOWER)
    w = words(data, offsets)
    h, doc = hash_spans(data, w.start, w.end, 2), w.doc
    place = np.arange(len(h)) - w.first[doc]
    left = w.counts[doc] - place
    shingle = np.zeros(len(h), np.uint64)
    for k, c in enumerate(odd_constants(SHINGLE_WORDS, 23)[: len(h)]):
        shingle[: len(h) - k] += np.where(left[: len(h) - k] > k, h[k:] * c, np.uint64(0))
    kept = (left >= SHINGLE_WORDS) | (place == 0)
    return doc[kept], mix(shingle[kept])


def _distinct(doc: np.ndarray, shingle: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((shingle, last, doc))
    shingle, doc, last = shingle[order], doc[order], last[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], shingle[new], last[new]


def shingle_sets(data: bytes, offsets: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, whether common) of all texts' distinct shingles in order; common: sorted shingles that go last."""
    doc, shingle = shingles_of(data, offsets)
    last = common[np.minimum(np.searchsorted(common, shingle), len(common) - 1)] == shingle if len(common) else np.zeros(len(shingle), bool)
    return _distinct(doc, shingle, last)


def _needed(spare: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of ``of`` shingles in random order must be looked at so that, if ``spare`` of them may be missing
    from a partner, all that are looked at are missing with a chance of at most MISS."""
    with np.errstate(divide="ignore"):
        few = np.ceil(np.log(1 / MISS) / np.log(of / np.maximum(spare, 1e-3)))
    return np.minimum(np.nan_to_num(few, posinf=1e9), spare + 1).astype(np.int64)


def key_places(doc: np.ndarray, last: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each shingle in order: whether it is a key, its place in its text's order, and the text's shingles."""
    n = np.bincount(doc, minlength=texts)
    rare = np.bincount(doc, weights=~last, minlength=texts).astype(np.int64)
    spare = n - -(-PART * n // WHOLE)
    many = rare > spare
    of_rare = np.where(many, _needed(spare, np.maximum(rare, spare + 1)), rare)
    of_common = np.where(many, 0, np.minimum(spare + 1 - rare, _needed(spare, np.maximum(n - rare, spare + 1))))
    at = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    return (at < of_rare[doc]) | (at >= rare[doc]) & (at - rare[doc] < of_common[doc]), at, n[doc]


def _texts(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _counters(shingle: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two counters, of ``size`` (a power of two), on which each shingle falls."""
    mask = np.uint64(size - 1)
    return (shingle & mask).view(np.int64), (shingle >> np.uint64(32) & mask).view(np.int64)


def _reached(texts: DataFrame, least: int, size: int) -> np.ndarray:
    """Whether each of ``size`` counters reaches ``least`` over all shingles of all texts, as packed bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(size, np.uint32)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                for at in _counters(shingles_of(*raw(part.column("text")))[1], size):
                    np.add.at(times, at, np.uint32(1))
        np.minimum(times, least, out=times)
        for panel, own in enumerate(times.reshape(-1, PANEL)):
            if own.any():
                kind = np.min_scalar_type(own.max())
                yield pa.RecordBatch.from_arrays([pa.array([panel]), pa.array([kind.itemsize]), pa.array([pa.compress(own.astype(kind), codec="zstd", asbytes=True)])], ["panel", "width", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[int, np.ndarray] = {}
        for batch in batches:
            for panel, width, packed in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(pa.decompress(packed, PANEL * width, codec="zstd", asbytes=True), f"u{width}")
                times.setdefault(panel, np.zeros(PANEL, np.int64))
                times[panel] += own
        bits = [np.packbits(own >= least).tobytes() for own in times.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*times], pa.int64()), pa.array(bits, pa.binary())], ["panel", "bits"])

    tables = texts.mapInArrow(count, "panel long, width long, packed binary").repartition("panel")
    bits = np.zeros((size // PANEL, PANEL // 8), np.uint8)
    for r in tables.mapInArrow(add, "panel long, bits binary").collect():
        bits[r.panel] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel()


def _counted(texts: DataFrame, reached: np.ndarray) -> DataFrame:
    """key, n: how many texts hold each of the shingles whose counters are both among ``reached``."""
    held, full = texts.sparkSession.sparkContext.broadcast(reached), HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(held.value).view(bool)
        found, size = [], 0

        def block() -> pa.RecordBatch:
            key, times = (np.concatenate(x) for x in zip(*found))
            key, at = np.unique(key, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, times, len(key)).astype(np.int64))], ["key", "n"])

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                doc, shingle = shingles_of(*raw(part.column("text")))
                one, two = _counters(shingle, len(often))
                kept = often[one] & often[two]
                shingle = _distinct(doc[kept], shingle[kept], np.zeros(np.count_nonzero(kept), bool))[1]
                found.append(np.unique(shingle, return_counts=True))
                size += len(found[-1][0])
                if size >= full:
                    yield block()
                    found, size = [], 0
        if found:
            yield block()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted shingles that COMMON_SHARE of all texts hold, and COMMON_LEAST at least.  n: how many texts there are."""
    least, texts = max(COMMON_LEAST, int(n * COMMON_SHARE)), _texts(docs)
    # A shingle takes two bytes of text in general and falls on two counters, so their mean is half of least, or less.
    wanted = 2 * (texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // least
    size = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << wanted.bit_length()))
    found = _counted(texts, _reached(texts, least, size)).where(F.col("n") >= least).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().view(np.uint64))


def keyed(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """a, t1, t2 (the text's hashes), n, keys, places, s1, s2: how many shingles each text has, its keys and their
    places in its order, and the bits set in most of its shingles.  Texts without words are left out."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                doc, shingle, last = shingle_sets(*raw(part.column("text")), held.value)
                per_text = np.bincount(doc, minlength=part.num_rows)
                bits = [pa.array(majority(h, per_text).view(np.int64)) for h in (shingle, mix(shingle ^ np.uint64(1)))]
                kept, at, n = key_places(doc, last, part.num_rows)
                doc, shingle, at = doc[kept], shingle[kept], at[kept]
                ends = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(shingle.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t1"), part.column("t2"), pa.array(per_text.astype(np.int32)), *lists, *bits], ["a", "t1", "t2", "n", "keys", "places", "s1", "s2"])

    sealed = _texts(docs).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    return sealed.mapInArrow(run, "a long, t1 long, t2 long, n int, keys array<long>, places array<int>, s1 long, s2 long").where("n > 0")


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                doc, shingle, _ = shingle_sets(*raw(part.column("text")), _NONE)
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle.view(np.int64)))], ["doc_id", "shingles"])

    return _texts(docs).mapInArrow(run, "doc_id long, shingles array<long>")


def _enough(shared: Column, n_a: Column, n_b: Column) -> Column:
    return shared * (PART + WHOLE) >= (n_a + n_b) * PART


def _may() -> Column:
    """Whether a and b can overlap enough if the key is the first shingle they share; it is for one key of each pair that does."""
    reach = _enough(F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")), F.col("n"), F.col("n_b"))
    apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in ("s1", "s2"))
    return reach & ((F.least("n", "n_b") < FEW) | (apart <= FAR))


#: What is known of a text beside each of its keys.
_OF = ("a", "n", "at", "s1", "s2")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough.  Only texts of pairs are read again."""
    pairs = cut(pairs.distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = cut(shingled(_texts(docs).join(maybe_broadcast(ids, 2 * pairs.count()), "doc_id", "left_semi")))
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    found = cut(pairs.where(_enough(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a"), F.size("set_b"))).select("a", "b").distinct())
    release(docs.sparkSession)
    return found


def pairs_of_keys(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of members of a key whose roots differ and that may overlap enough.  rows: key, root and what
    _OF names, with the key's number of ``blocks``: block i meets block j >= i in a cell of their own."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    left = dealt.select("key", *_OF, "root", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"))
    right = dealt.select("key", *(F.col(c).alias(f"{c}_b") for c in (*_OF, "root")), F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("block").alias("j"))
    once = (F.col("i") < F.col("j")) | (F.col("a") < F.col("a_b"))
    met = left.join(right, ["key", "i", "j"]).where(once & (F.col("root") != F.col("root_b")) & _may())
    return met.select(F.least("a", "a_b").alias("a"), F.greatest("a", "a_b").alias("b"))


def similar_links(docs: DataFrame, equal: bool = False) -> DataFrame:
    """(a, b): links that join all different texts of enough overlap; every link is verified.  equal: also from
    each document to the least one of the same text."""
    packed = cut(keyed(docs, common_shingles(docs, docs.count())))
    first = packed.groupBy("t1", "t2").agg(F.min("a").alias("b"))
    own = packed.join(first.select(F.col("b").alias("a")), "a", "left_semi")
    rows = own.select("a", "n", "s1", "s2", F.explode(F.arrays_zip("keys", "places")).alias("k")).select(F.col("k.keys").alias("key"), "a", "n", F.col("k.places").alias("at"), "s1", "s2")
    heads = rows.groupBy("key").agg(F.min(F.struct(*_OF)).alias("head"), F.max("a").alias("most"), F.count(F.lit(1)).alias("size")).where("head.a < most")
    heads = cut(heads.select("key", *(F.col(f"head.{c}").alias("b" if c == "a" else f"{c}_b") for c in _OF), "size"))
    shared = cut(join_facts(rows, heads, "key", "size"))
    release(docs.sparkSession)
    stars = verified(shared.where("a <> b").where(_may()).select("a", "b"), docs)
    roots = components(stars).select(F.col("node").alias("a"), "root")
    placed = shared.select("key", *_OF).join(roots, "a", "left").withColumn("root", F.coalesce("root", "a"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    several = cut(several.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), "size"))
    left = cut(join_facts(placed, several, "key", "size"))
    found = stars.unionByName(verified(pairs_of_keys(left), docs))
    return found.unionByName(packed.join(first, ["t1", "t2"]).where("a <> b").select("a", "b")) if equal else found


def near_copies(docs: DataFrame, among: DataFrame) -> DataFrame:
    """doc_id, root: documents of ``among`` (doc_id) with near copies among them, and their group's least id."""
    texts = cut(_texts(docs).join(among.distinct(), "doc_id", "left_semi"))
    return components(similar_links(texts, equal=True)).select(F.col("node").alias("doc_id"), "root")
