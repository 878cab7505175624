"""Language ID: scripts narrow the candidates, character n-grams score each word, Viterbi labels spans.

A word's score for a language is the log-likelihood of the n-grams of its UTF-8 bytes (two and three,
with word ends) under that language, halved, as each letter ends one of each.  Languages that hardly use
the word's script are no candidates.  The best path through a text pays a penalty for every switch, so
that spans of mixed texts are labelled while single odd words are not.  Where no stretch of words gains
more than half a penalty by any other language, staying with the best one is provably the best path, and
the dynamic programme is left out.

Learning takes texts with a language outside the held-out fold, at most TRAIN_ROWS of them, drawn by hash.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and no span; without any
labelled text all texts are ``und``; rows with a null id are labelled (held_out is null); ties go to the
language that comes first by code point; repeated rows are labelled each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import ship, table

from .sampling import at_most, fold
from .text import PIECE_BYTES, Words, pieces, raw, words

NAME = "op8_language_id"
ORACLE_SQL = None

FOLDS, HELD_OUT = 3, 1
#: The bound on what is learnt from.
TRAIN_ROWS = 20_000

UNKNOWN = "und"
PENALTY = 12.0
SMOOTH = 0.5
#: A language is a candidate for a script that writes at least this share of its words.
LEAST_SHARE = 0.001
#: Pairs of bytes have a row of weights each, triples share 2 ** TRIPLE_BITS by hash.
PAIRS, TRIPLE_BITS = 1 << 16, 17

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LETTER, LAST = regex.compile(r"\p{L}"), regex.compile(r"(?r)\p{L}\p{M}*")

#: First and last code point of the main ranges of each script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
)


#: Scripts by name; the last number stands for all others.
SCRIPT_NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS))


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    candidates: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), bool))  # by script and language


def letters_only(texts: pa.Array) -> Words:
    """The lower-cased words of letters and marks, each between spaces."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM]+", " ")
    space = pa.scalar(" ", plain.type)
    return words(*raw(pc.binary_join_element_wise(space, plain, space, pa.scalar("", plain.type))))


def gram_rows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The rows of weights of the pair and of the triple that end at each byte."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    one, two = np.full(len(b), 32, np.uint32), np.full(len(b), 32, np.uint32)
    one[1:], two[2:] = b[:-1], b[:-2]
    two[one == 32] = 32
    pair = one << 8 | b
    triple = ((two << 16 | pair) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIPLE_BITS)
    return pair, triple + np.uint32(PAIRS)


def script_numbers(w: Words) -> np.ndarray:
    """The script of each word's first letter."""
    b = np.frombuffer(w.data + bytes(3), np.uint8).astype(np.int64)
    lead = b[w.start]
    tail = [b[w.start + k] & 0x3F for k in (1, 2, 3)]
    point = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, (lead & 0x1F) << 6 | tail[0], (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]], (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])
    out = np.full(len(lead), len(SCRIPT_NAMES))
    for name, low, high in SCRIPTS:
        out[(point >= low) & (point <= high)] = SCRIPT_NAMES.index(name)
    return out


def word_scores(w: Words, model: Model) -> np.ndarray:
    """A row of scores by language for each word."""
    if not len(w.start):
        return np.zeros((0, len(model.languages)))
    pair, triple = gram_rows(w.data)
    each = model.weights[pair] + model.weights[triple]
    # Up to the next word: the word, the space that ends it, and maybe the space that opens the next text.
    b = np.frombuffer(w.data, np.uint8)
    each[1:][(b[1:] == 32) & (b[:-1] == 32)] = 0
    each[: w.start[0]] = 0
    scores = np.add.reduceat(each, w.start, axis=0).astype(float) / 2
    fits = model.candidates[script_numbers(w)]
    none = ~fits.any(axis=1)
    scores = np.where(fits, scores, scores.min(axis=1, keepdims=True) - 100.0)
    scores[none] = 0
    return scores


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language index of each word on the best path."""
    n, k = scores.shape
    total = scores.sum(axis=0)
    best = int(np.argmax(total))
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, k)), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty / 2:
        return np.full(n, best)
    rows = scores.tolist()
    now, back = rows[0], []
    for row in rows[1:]:
        top = max(now)
        lead, floor = now.index(top), top - penalty
        back.append([i if v >= floor else lead for i, v in enumerate(now)])
        now = [(v if v >= floor else floor) + s for v, s in zip(now, row)]
    path = [now.index(max(now))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


_SCRIPT_ROWS = PAIRS + (1 << TRIPLE_BITS)


def _train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            for lang in part.column("lang").unique().to_pylist():
                w = letters_only(part.filter(pc.equal(part.column("lang"), lang)).column("text"))
                b = np.frombuffer(w.data, np.uint8)
                inside = np.ones(len(b), bool)
                inside[1:] = (b[1:] != 32) | (b[:-1] != 32)
                inside[:1] = False
                rows = np.concatenate([*(r[inside] for r in gram_rows(w.data)), script_numbers(w).astype(np.uint32) + np.uint32(_SCRIPT_ROWS)])
                row, n = np.unique(rows, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(row), pa.string()), pa.array(row.astype(np.int32)), pa.array(n)], ["lang", "row", "n"])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text, lang; rows of the held-out fold must be gone already.  The counts that come to the
    driver are at most one for each language and row of weights."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    drawn = at_most(rows.select("doc_id", "lang"), train_rows).select("doc_id").distinct()
    train = rows.join(F.broadcast(drawn), "doc_id", "left_semi").select("text", "lang")
    counts = train.mapInArrow(_train_counts, "lang string, row int, n long").groupBy("lang", "row").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return Model()
    languages = sorted(counts.lang.unique().tolist(), key=lambda x: x.encode())
    n = np.zeros((_SCRIPT_ROWS + len(SCRIPT_NAMES) + 1, len(languages)))
    n[counts.row, counts.lang.map(languages.index)] = counts.n
    grams, scripts = n[:_SCRIPT_ROWS] + SMOOTH, n[_SCRIPT_ROWS:]
    for part in (grams[:PAIRS], grams[PAIRS:]):
        part /= part.sum(axis=0)
    return Model(languages, np.log(grams).astype(np.float32), scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=0), 1))


def label(docs: DataFrame, model: Model, spans: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (the share of words in that language); spans: also (lang, low, high) by
    character; carry: further columns of docs to keep."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        # Word scores take room for each byte and language.
        limit = PIECE_BYTES * 4 // max(4, len(model.languages))
        for batch in batches:
            for part in pieces(batch, "text", limit):
                lettered = pc.match_substring_regex(pc.fill_null(part.column("text"), ""), r"\pL").to_pylist()
                w = letters_only(part.column("text"))
                scores = word_scores(w, model) if model.languages else None
                chosen, sure, listed = [], [], []
                for d, has_letter in enumerate(lettered):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    if not has_letter or scores is None or a == b:
                        chosen.append(UNKNOWN)
                        sure.append(0.0)
                        listed.append([])
                        continue
                    path = best_path(scores[a:b])
                    n = np.bincount(path, minlength=len(model.languages))
                    chosen.append(model.languages[int(n.argmax())])
                    sure.append(float(n.max() / (b - a)))
                    if spans:
                        head = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
                        if len(head) == 1:
                            whole = part.column("text")[d].as_py()
                            listed.append([{"lang": model.languages[path[0]], "low": LETTER.search(whole).start(), "high": LAST.search(whole).end()}])
                            continue
                        # Lower-casing may change lengths; words keep their order and number but for rare letters.
                        place = [m.span() for m in WORD.finditer(part.column("text")[d].as_py())]
                        last = [*(head[1:] - 1), len(path) - 1]
                        listed.append([{"lang": model.languages[path[x]], "low": place[min(x, len(place) - 1)][0], "high": place[min(y, len(place) - 1)][1]} for x, y in zip(head, last)])
                out = [part.column("doc_id"), pa.array(chosen, pa.string()), pa.array(sure, pa.float64())]
                if spans:
                    out.append(pa.array(listed, pa.list_(pa.struct([("lang", pa.string()), ("low", pa.int32()), ("high", pa.int32())]))))
                names = ["doc_id", "lang_pred", "score", "spans"][: len(out)]
                yield pa.RecordBatch.from_arrays([*out, *(part.column(c) for c in carry)], [*names, *carry])

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,low:int,high:int>>" * spans
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for c in carry for f in docs.schema if f.name == c)
    others = [c for c in carry if c != "text"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *others).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return label(docs, model, spans=True).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents labelled ``und`` go: null texts and texts without a letter.  The others carry the predicted
    language, whatever was given; without any language to learn from they keep what they had."""
    model = fit(docs)
    found = label(docs, model, carry=("text", "lang", "source", "n_chars"))
    if model.languages:
        return found.where(F.col("lang_pred") != UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")
    return found.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang", "source", "n_chars")
