"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below one fixed fraction of the hash space, the same for all texts, and has
a floor that all sketches share: the FLOOR least hashes are always kept, so that a text of up to FLOOR distinct
shingles is kept whole.  A sketch says up to which hash it is complete.  Two sketches are compared below the
lesser of their limits, where both are complete, which makes containment estimates unbiased between texts of
very unequal lengths and lets sketches of parts be merged by union.  Where a text has no shingle below that
limit nothing can be said of it, and the estimate is the smaller text's share of both texts' shingles.

Defined cases: null reads as empty; texts without words have an empty sketch, like only to another empty
one; under five words the whole sequence is the one shingle; repeated ids are ordered by XXH64 of the text,
then by text, nulls first; null ids come after all others,
with the lowest long if that is an id; a single document is its own next; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import ship, shuffle_width, table

from .text import LOWER, hash_spans, mix, odd_constants, pieces, raw, words

NAME = "op3_document_fingerprints"
ORACLE_SQL = None

SHINGLE_WORDS = 5
#: Hashes up to LIMIT are kept, a quarter of all, and the FLOOR least ones at any rate.
LIMIT = (1 << 62) - 1
FLOOR = 128
ALL = (1 << 64) - 1
#: Rows drawn (about) for each bucket of the range shuffle, and in all at most, to find its bounds.
DRAWN, MOST_DRAWN = 64, 1 << 20


@dataclass
class Sketch:
    """hashes: ascending, all of the text's up to limit."""

    limit: int
    hashes: np.ndarray

    def text(self) -> str:
        """The limit, and the upper 40 bits of each hash in order."""
        kept = (self.hashes >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
        return f"{self.limit:x}:{b64encode(kept.tobytes()).decode()}"

    def size(self) -> float:
        """How many shingles the text has, about."""
        return len(self.hashes) * (ALL / self.limit)

    def at(self, limit: int) -> np.ndarray:
        return self.hashes[: np.searchsorted(self.hashes, np.uint64(limit), side="right")] if limit < self.limit else self.hashes

    def merge(self, other: Sketch) -> Sketch:
        limit = min(self.limit, other.limit)
        return Sketch(limit, np.union1d(self.at(limit), other.at(limit)))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the smaller shingle set that the larger one contains."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    limit = min(a.limit, b.limit)
    x, y = a.at(limit), b.at(limit)
    if not len(x) or not len(y):
        return min(a.size(), b.size()) / (a.size() + b.size())
    return len(np.intersect1d(x, y, assume_unique=True)) / min(len(x), len(y))


def sketches(texts: pa.Array, k: int = SHINGLE_WORDS) -> list[Sketch]:
    data, offsets = raw(texts)
    data = data.translate(LOWER)
    w = words(data, offsets)
    h = hash_spans(data, w.start, w.end)
    n = w.counts
    per_doc = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), per_doc)
    at = w.first[doc] + np.arange(len(doc)) - (np.cumsum(per_doc) - per_doc)[doc]
    size = np.minimum(n, k)[doc]
    out = np.zeros(len(doc), np.uint64)
    for i, c in enumerate(odd_constants(k, 5)):
        inside = size > i
        out[inside] += h[at[inside] + i] * c
    out = mix(out + size.astype(np.uint64))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    distinct = np.bincount(doc, minlength=len(n))
    first = np.append(0, np.cumsum(distinct))
    # The limit: the fixed one, or that of the floor where fewer are below it.
    floor = np.full(len(n), ALL, np.uint64)
    more = distinct > FLOOR
    floor[more] = out[first[:-1][more] + FLOOR - 1]
    limit = np.maximum(floor, np.uint64(LIMIT))
    kept = out <= limit[doc]
    out, first = out[kept], np.append(0, np.cumsum(np.bincount(doc[kept], minlength=len(n))))
    return [Sketch(int(x), out[a:b]) for x, a, b in zip(limit, first[:-1], first[1:])]


@dataclass
class _Row:
    doc_id: int | None
    text: str
    sketch: Sketch


def _compared(rows: list[_Row], after: list[_Row]) -> pa.RecordBatch:
    """A result row for each of rows, whose next documents are those of after."""
    edited = [r.text[: len(r.text) - len(r.text) // 3] + n.text[: len(r.text) // 3] for r, n in zip(rows, after)]
    drawn = sketches(pa.array(edited, pa.large_string()))
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([r.doc_id for r in rows], pa.int64()),
            "n_chars": pa.array([len(r.text) for r in rows], pa.int64()),
            "edited_sha256": [sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [r.sketch.text() for r in rows],
            "edited_fingerprint": [s.text() for s in drawn],
            "near_edited": [containment(r.sketch, s) for r, s in zip(rows, drawn)],
            "near_next": [containment(r.sketch, n.sketch) for r, n in zip(rows, after)],
        }
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows in order; after them, the document that follows in another partition."""
    waiting: list[_Row] = []
    for batch in batches:
        for part in pieces(batch, "text"):
            texts = pc.fill_null(part.column("text"), "")
            rows = [_Row(*x) for x in zip(part.column("doc_id").to_pylist(), texts.to_pylist(), sketches(texts))]
            guests = part.column("guest").to_pylist()
            own = guests.index(True) if True in guests else len(rows)
            line = waiting + rows[: own + 1]
            if own < len(rows):
                if len(line) > 1:
                    yield _compared(line[:-1], line[1:])
                return
            if len(line) > 1:
                yield _compared(line[:-1], line[1:])
            waiting = line[-1:]


def bucket_of(first: np.ndarray, second: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bounds, sorted pairs, are not above each pair (first, second)."""
    low, high = (np.searchsorted(bounds[0], first, side=side) for side in ("left", "right"))
    for at in np.unique(low[low < high]):
        some = np.flatnonzero((low == at) & (low < high))
        low[some] += np.searchsorted(bounds[1][at : high[some[0]]], second[some], side="right")
    return low.astype(np.int32)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document.

    Documents are dealt out by ranges of (id, hash of the text) and sorted there; the bounds are quantiles of a
    sample, so that neither wide gaps between ids nor repeated ones fill a range.  Each range also gets the
    first document of the one that follows it, so texts are shuffled once and no task sees more than a range.
    """
    spark = docs.sparkSession
    ship(spark)
    n = shuffle_width(spark)
    # ~x turns the order of all longs around.
    turned = F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns({"place": turned, "tie": F.xxhash64("text")})
    share = min(1.0, DRAWN * n / max(1, docs.count()), MOST_DRAWN / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("place", "tie", F.lit(1)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("place", "tie").distinct()
    # About DRAWN rows for each bucket come to the driver, however many documents there are.
    pairs = sorted((r.place, r.tie) for r in drawn.collect())
    cuts = [pairs[k * len(pairs) // n] for k in range(1, n) if pairs]
    bounds = tuple(np.array([c[k] for c in cuts], np.int64) for k in (0, 1))

    @F.pandas_udf("int")
    def bucket(place: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(place.to_numpy(np.int64), tie.to_numpy(np.int64), bounds))

    dealt = docs.withColumn("bucket", bucket("place", "tie"))
    # At most one row for each bucket: its first document.
    heads = sorted((r.bucket, r.head.place, r.head.tie) for r in dealt.groupBy("bucket").agg(F.min(F.struct("place", "tie")).alias("head")).collect())
    lent = [(place, tie, heads[k - 1][0]) for k, (_, place, tie) in enumerate(heads)]
    guests = F.broadcast(spark.createDataFrame(lent, "place long, tie long, lent int"))
    own = F.struct("bucket", F.lit(False).alias("guest"))
    both = F.when(F.col("lent").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("lent").alias("bucket"), F.lit(True).alias("guest"))))
    dealt = dealt.join(guests, ["place", "tie"], "left").select("doc_id", "text", "place", "tie", F.explode(both).alias("to")).select("*", "to.bucket", "to.guest")
    dealt = dealt.repartitionById(n, F.col("bucket"))
    dealt = dealt.sortWithinPartitions("guest", "place", "tie", F.asc_nulls_first("text"))
    return dealt.select("doc_id", "text", "guest").mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
