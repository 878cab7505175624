"""Substring dedup by recompression.

A word is removed if a window of consecutive words covers it that also starts in a document with a
smaller id.  Equal windows have equal anchors (see ``recompress``), so

1. every task names the anchors of its windows and asks, by name, whether other documents have them;
2. documents that share an anchor hash the windows around it, and windows are compared by anchor name
   and window hash together: 48 and 64 bits of two independent hashes of the words' bytes, under keys drawn
   anew for each run, so that unequal windows pass for equal with a chance of about 2 ** -112 whatever the
   texts, and none can be made to;
3. the words under repeated windows are cut out.

Before either shuffle a task answers what it can see itself: of the documents of one piece of text that
share a name or window, only the least asks, so a passage found in a third of all documents is asked for
once per piece (several MB of text), not once per document.  Questions travel as packed arrays, one row
for each piece and bucket.  Texts are shuffled once; both joins read the same exchange.

Defined cases: null texts have no words; repeated rows and equal ids never repeat each other, and lose
the same words; a null id neither removes nor is removed; texts with fewer words than a window stay
whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from secrets import randbits

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import ship, shuffle_width, table

from .recompress import anchors, levels, window_starts
from .text import Words, hash_spans, pieces, raw, window_hash, words

NAME = "op10_substring_dedup"
ORACLE_SQL = None

WINDOW = 13


def _parsed(part: pa.RecordBatch, size: int, key: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, the window starts of texts with an id, and each window's anchor."""
    w = words(*raw(part.column("text")))
    h = hash_spans(w.data, w.start, w.end, key)
    starts = window_starts(w.first, size)
    has_id = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    starts = starts[has_id[w.doc[starts]]]
    name = anchors(levels(h, w.doc), starts, size, np.append(0, np.cumsum(w.end - w.start)))
    return w, starts, name


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins; none where there are no rows."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _spread(at: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))


def _packed(bucket: np.ndarray, n_buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(bucket, kind="stable")
    columns = [c[order] for c in columns]
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), [c[cuts[b] : cuts[b + 1]].tobytes() for c in columns]


def _unpacked(batches: list[pa.RecordBatch], kinds: dict[str, type]) -> list[np.ndarray]:
    parts: dict[str, list[bytes]] = {k: [] for k in kinds}
    for batch in batches:
        for k in kinds:
            parts[k] += batch.column(k).to_pylist()
    return [np.frombuffer(b"".join(parts[k]), kind) for k, kind in kinds.items()]


# ---------------------------------------------------------------- 1: shared anchors


def _ask_anchors(size: int, n_buckets: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w, starts, name = _parsed(part, size, key)
                ids = _ids(part)[w.doc[starts]]
                at = _heads(name, ids)
                name, ids = name[at], ids[at]
                order = np.lexsort((ids, name))
                name, ids = name[order], ids[order]
                at = _heads(name, ids)
                name, ids = name[at], ids[at]
                first = _heads(name)
                rows = [(b, n, i, False) for b, (n, i) in _packed((name[first] % np.uint64(n_buckets)).astype(np.int64), n_buckets, [name[first], ids[first]])]
                many = np.repeat(np.diff(np.append(first, len(name))) > 1, np.diff(np.append(first, len(name))))
                if many.any():
                    rows.append((int(name[0] % np.uint64(n_buckets)), name[many].tobytes(), ids[many].tobytes(), True))
                bucket, names, docs, known = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(names, pa.binary()), pa.array(docs, pa.binary()), pa.array(known, pa.bool_())], ["bucket", "names", "docs", "known"])

    return run


def _known_first(batches: Iterator[pa.RecordBatch], asked: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose answer is known; the others are put aside."""
    for batch in batches:
        known = batch.column("known")
        asked.append(batch.filter(pc.invert(known)))
        yield batch.filter(known)


def _shared_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, name) of names that two documents have: as a task found, or over all that asked."""

    def out(name: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(name), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(doc[k : k + (1 << 16)]), pa.array(name[k : k + (1 << 16)].view(np.int64))], ["doc_id", "name"])

    kinds, asked = {"names": np.uint64, "docs": np.int64}, []
    for batch in _known_first(batches, asked):
        yield from out(*_unpacked([batch], kinds))
    name, doc = _unpacked(asked, kinds)
    order = np.lexsort((doc, name))
    name, doc = name[order], doc[order]
    if len(name):
        at = _heads(name)
        last = np.append(at[1:], len(name)) - 1
        shared = (doc[at] != doc[last])[_spread(at, len(name))]
        yield from out(name[shared], doc[shared])


# ---------------------------------------------------------------- 2: repeated windows

_RUN = {"run_name": np.uint64, "run_doc": np.int64, "run_at": np.int32, "run_size": np.uint8, "hashes": np.uint64}
_ASKED = "bucket int, run_name binary, run_doc binary, run_at binary, run_size binary, hashes binary, known boolean"


def _runs(name: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads and sizes of runs of consecutive windows of one document with one anchor, 255 at most."""
    if not len(name):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    step = at - np.arange(len(at))
    head = _heads(name, doc, step)
    place = np.arange(len(at)) - head[_spread(head, len(at))]
    head = np.flatnonzero(place % 255 == 0)
    return head, np.diff(np.append(head, len(at))).astype(np.uint8)


def _ask_windows(size: int, n_buckets: int, keys: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("names").is_valid())
            for part in pieces(batch, "text") if batch.num_rows else ():
                w, starts, name = _parsed(part, size, keys[0])
                wanted = np.unique(part.column("names").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                place = np.minimum(np.searchsorted(wanted, name), max(len(wanted) - 1, 0))
                kept = wanted[place] == name if len(wanted) else np.zeros(len(name), bool)
                starts, name = starts[kept], name[kept]
                if not len(starts):
                    continue
                hashes = window_hash(hash_spans(w.data, w.start, w.end, keys[1]), size, keys[1])[starts]
                doc = w.doc[starts]
                ids, at = _ids(part)[doc], (starts - w.first[doc]).astype(np.int32)
                order = np.lexsort((ids, hashes, name))
                head = _heads(name[order], hashes[order])
                least = np.empty(len(order), np.int64)
                least[order] = ids[order][head][_spread(head, len(order))]
                asks = ids == least
                rows = []
                for known, some in ((False, asks), (True, ~asks)):
                    n, d, a, x = name[some], ids[some], at[some], hashes[some]
                    # Known repeats need no anchor and no hash: runs of them are stretches of one text.
                    run_head, run_size = _runs(np.zeros(len(n), np.uint64) if known else n, d, a)
                    if not len(run_head):
                        continue
                    columns = [n[run_head], d[run_head], a[run_head], run_size]
                    if known:
                        rows.append((int(d[0] % n_buckets), *(c.tobytes() for c in columns), b"", True))
                        continue
                    bucket = (columns[0] % np.uint64(n_buckets)).astype(np.int64)
                    of_each = _packed(np.repeat(bucket, run_size), n_buckets, [x])
                    rows += [(b, *c, own[0], False) for (b, c), (_, own) in zip(_packed(bucket, n_buckets, columns), of_each)]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:6]), pa.array(columns[6], pa.bool_())], ["bucket", *_RUN, "known"])

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, low, high): windows low to high - 1 of the document start in a smaller one too."""

    def out(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(doc), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(at[s].astype(np.int32)), pa.array((at[s] + n[s]).astype(np.int32))], ["doc_id", "low", "high"])

    asked: list[pa.RecordBatch] = []
    for batch in _known_first(batches, asked):
        _, doc, at, n, _ = _unpacked([batch], _RUN)
        yield from out(doc, at, n.astype(np.int32))
    name, doc, at, n, hashes = _unpacked(asked, _RUN)
    if not len(name):
        return
    n = n.astype(np.int64)
    name, doc, at = np.repeat(name, n), np.repeat(doc, n), np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    order = np.lexsort((doc, hashes, name))
    head = _heads(name[order], hashes[order])
    least = np.empty(len(order), np.int64)
    least[order] = doc[order][head][_spread(head, len(order))]
    doc, at = doc[doc > least], at[doc > least]
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    head = _heads(doc, at - np.arange(len(at)))
    yield from out(doc[head], at[head], np.diff(np.append(head, len(at))))


# ---------------------------------------------------------------- 3: cutting


def _cut(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(*raw(part.column("text")))
                spans = part.column("spans")
                change = np.zeros(len(w.start) + 1, np.int64)
                if spans.null_count < len(spans):
                    doc = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    flat = spans.flatten()
                    low, high = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + w.first[doc] for k in ("low", "high"))
                    np.add.at(change, low, 1)
                    np.add.at(change, high + size - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                removed = np.diff(np.append(0, np.cumsum(gone))[w.first])
                digests, texts = [], []
                data = w.data
                for d in range(part.num_rows):
                    a, b = w.first[d], w.first[d + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a
                    start, end = w.start[stay].tolist(), w.end[stay].tolist()
                    digests.append(sha256(b" ".join([data[s:e] for s, e in zip(start, end)])).hexdigest())
                    if with_text:
                        lo, hi = int(w.offsets[d]), int(w.offsets[d + 1])
                        if removed[d]:
                            # Each removed run goes with the white space after it.
                            edge = _heads(gone[a:b])
                            at = np.append(w.start[a:b][edge], hi)
                            out = b"".join(data[at[i] : at[i + 1]] for i in range(len(edge)) if not gone[a + edge[i]])
                            texts.append((data[lo : w.start[a]] + out).decode())
                        else:
                            texts.append(data[lo:hi].decode())
                out = [part.column("doc_id"), pa.array(w.counts), pa.array(removed), pa.array(digests)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    out, names = [*out, pa.array(texts), *(part.column(c) for c in part.schema.names if c not in ("doc_id", "text", "spans"))], [*names, "kept_text", *(c for c in part.schema.names if c not in ("doc_id", "text", "spans"))]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def repeated_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, spans: array of (low, high), windows that start in a smaller document too."""
    ship(docs.sparkSession)
    n = shuffle_width(docs.sparkSession)
    keys = randbits(62), randbits(62)
    asked = docs.mapInArrow(_ask_anchors(size, n, keys[0]), "bucket int, names binary, docs binary, known boolean")
    shared = asked.repartitionById(n, "bucket").mapInArrow(_shared_names, "doc_id long, name long")
    names = shared.groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    asked = docs.join(names.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_ask_windows(size, n, keys), _ASKED)
    spans = asked.repartitionById(n, "bucket").mapInArrow(_repeats, "doc_id long, low int, high int")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def without_repeats(docs: DataFrame, size: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with_text: also kept_text and the other columns of docs."""
    ship(docs.sparkSession)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    bare = docs.select("doc_id", "text")
    whole = docs if with_text else bare
    marked = whole.join(repeated_spans(bare, size).hint("shuffle_hash"), "doc_id", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema += ", kept_text string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("doc_id", "text"))
    return marked.mapInArrow(_cut(size, with_text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeats; documents of which nothing is left go."""
    found = without_repeats(docs.select("doc_id", "text", "lang", "source", "n_chars"), with_text=True)
    kept = found.where("n_removed = 0 OR n_removed < n_words")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))
