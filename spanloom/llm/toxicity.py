"""Toxicity by maximum-scoring segments.

Word scores are log-odds of document frequencies in toxic against other documents, with a Dirichlet prior in
proportion to each word's overall frequency; the score is the end of its confidence interval that is nearer to
zero, for words of either kind, and every word costs a small drift, so that a random text scores below zero.
A linear-time scan finds all maximal scoring segments of a text.  Their scores follow an extreme-value law
whose rate solves sum p(w) exp(rate s(w)) = 1 over the words of other documents; its scale is read off the
training documents.  A document's evidence is the sum over its segments with an expected count (e-value) below
0.05, and a one-variable logistic fit turns it into a probability.

Learning takes labelled rows outside the held-out fold, at most TRAIN_ROWS of them, drawn by hash; exact
copies count once.  The scale and the logistic fit are read off the rows that the odds were learnt from.
Nothing but the text enters a score.

Defined cases: null and empty texts have no segment and get the score of no evidence; rows with a null id
are scored (held_out is null); conflicting labels of one id, or of equal texts, count as toxic; without labels
of both kinds every score is the share of toxic labels (0 without labels); repeated rows are scored each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import cut, ship, table

from .sampling import at_most, fold
from .text import BARE, Words, hash_spans, pieces, raw, words

NAME = "op4_toxicity"
ORACLE_SQL = None

FOLDS = 5
#: The bound on what is learnt from.
TRAIN_ROWS = 50_000

#: The prior's weight as a share of all counts; half-width of the interval in standard errors.
PRIOR, WIDTH = 0.02, 1.5
LEAST_SCORE, LEAST_DRIFT = 0.5, 0.1
SIGNIFICANT = 0.05


@dataclass
class Model:
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = LEAST_DRIFT
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -50.0

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(evidence) + self.offset, -50, 50)))


def tokens_of(part: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    """Bare words of the lower-cased texts, and their hashes."""
    w = words(*raw(pc.utf8_lower(pc.fill_null(part.column("text"), ""))), inside=BARE)
    return w, hash_spans(w.data, w.start, w.end)


def scores_of(h: np.ndarray, model: Model) -> np.ndarray:
    """Each word's score, less the drift; 0 less the drift where the model has none."""
    if not len(model.tokens) or not len(h):
        return np.full(len(h), -model.drift)
    place = np.minimum(np.searchsorted(model.tokens, h), len(model.tokens) - 1)
    return np.where(model.tokens[place] == h, model.scores[place], 0.0) - model.drift


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (low, high, score).  Each candidate keeps the sums before and after it, and
    a link to the last candidate that starts lower, so that candidates are passed over once."""
    found: list[list] = []  # low, high, sum before, sum after, index of the last with a lower sum before
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.append(0.0, np.cumsum(scores))
    for place, before, total in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        low, left, right = place, before, total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([low, place + 1, left, right, j])
                break
            # The candidate j is extended up to here and takes in all after it.
            low, left = found[j][0], found[j][2]
            link = found[j][4]
            del found[j:]
            j = link
    return [(a, b, r - le) for a, b, le, r, _ in found]


def segments_of(part: pa.RecordBatch, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]], Words]]:
    """For each text its number of tokens and its maximal segments."""
    w, h = tokens_of(part)
    scores = scores_of(h, model)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        yield b - a, maximal_segments(scores[a:b]), w


def log_e(score: float, n: int, model: Model) -> float:
    return model.log_k + np.log(max(n, 1)) - model.rate * score


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """Sum of -log e over significant segments; else that of the best one, at most 0 less than significant."""
    scores = [-log_e(s, n, model) for _, _, s in found]
    strong = [x for x in scores if x > -np.log(SIGNIFICANT)]
    return float(sum(strong)) if strong else float(max(min(max(scores, default=-10.0), -np.log(SIGNIFICANT)), -10.0))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            w, h = tokens_of(part)
            doc = w.doc
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            token, index = np.unique(h[new], return_inverse=True)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[doc[new]] > 0
            n = [np.bincount(index[toxic == x], minlength=len(token)) for x in (False, True)]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n[0]), pa.array(n[1])], ["token", "n0", "n1"])


def _rate(gain: np.ndarray, p: np.ndarray, drift: float) -> float:
    """The positive root of sum p exp(rate s) = 1."""
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        if np.sum(p * np.exp(np.clip(mid * (gain - drift), -500, 500))) + (1 - p.sum()) * np.exp(-mid * drift) > 1:
            high = mid
        else:
            low = mid
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset, by Newton's method with a slight pull towards zero."""
    a = b = 0.0
    ridge = 1e-2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = p * (1 - p)
        grad = np.array([np.sum((p - y) * x) + ridge * a, np.sum(p - y) + ridge * b])
        hess = np.array([[np.sum(w * x * x) + ridge, np.sum(w * x)], [np.sum(w * x), np.sum(w) + ridge]])
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        step *= min(1.0, 2.0 / max(size, 1e-12))
        a, b = a - step[0], b - step[1]
        if size < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text.  labels: doc_id, toxic; rows of the held-out fold must be gone already."""
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = at_most(known, train_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    train = cut(train.groupBy(F.xxhash64("text").alias("same"), F.xxhash64(F.lit(1), "text").alias("too")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    counts = cut(train.mapInArrow(_counts, "token long, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    kinds = {r.toxic: r["count"] for r in train.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    model = Model()
    if not kinds.get(True) or not kinds.get(False):
        rate = kinds.get(True, 0) / max(1, sum(kinds.values()))
        model.offset = float(np.log(max(rate, 1e-20) / max(1 - rate, 1e-20)))
        return model
    total = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).head()
    n = total.n0 + total.n1
    prior, weight = PRIOR * (F.col("n0") + F.col("n1")), PRIOR * n
    odds = [F.log((F.col(c) + prior) / (t + weight - F.col(c) - prior)) for c, t in (("n1", total.n1), ("n0", total.n0))]
    error = F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    odds, error = odds[0] - odds[1], WIDTH * error
    # The end of the interval that is nearer to no preference.
    least = F.when(odds > error, odds - error).when(odds < -error, odds + error)
    scored = counts.select("token", "n0", "n1", least.alias("score")).where((F.col("score") < -LEAST_SCORE) | (F.col("n1") > 1) & (F.col("score") > LEAST_SCORE))
    # Words of the training texts, of which there are TRAIN_ROWS at most.
    rows = scored.toPandas()
    token, gain = rows["token"].to_numpy(np.int64).view(np.uint64), rows["score"].to_numpy(float)
    p = ((rows["n0"] + PRIOR * (rows["n0"] + rows["n1"])) / (total.n0 + PRIOR * n)).to_numpy(float)
    order = np.argsort(token)
    model.tokens, model.scores = token[order], gain[order]
    model.drift = max(LEAST_DRIFT, 2 * float(np.sum(p * gain)))
    model.rate = _rate(gain, p, model.drift)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [(n, max((s for _, _, s in some), default=0.0), evidence(n, some, model)) for n, some, _ in segments_of(part, model)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found], of) for k, of in enumerate((pa.int64(), pa.float64(), pa.float64()))), part.column("toxic").cast(pa.int32())], ["n", "best", "x", "toxic"])

    # Four numbers for each training text; first for the scale of the extreme values, then with it.
    seen = train.mapInArrow(best, "n long, best double, x double, toxic int").toPandas()
    clean = seen[seen.toxic == 0]
    level = np.quantile(model.rate * clean.best - np.log(np.maximum(clean.n, 1)), 0.95)
    model.log_k = float(level + np.log(-np.log(0.95)))
    seen = train.mapInArrow(best, "n long, best double, x double, toxic int").toPandas()
    x = np.arcsinh(seen.x.to_numpy(float))
    model.slope, model.offset = _logistic(x, (seen.toxic > 0).to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """doc_id, score; passages: also the significant segments with their e-values and (lower-cased) texts."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in pieces(batch, "text"):
                values, listed = [], []
                for d, (n, found, w) in enumerate(segments_of(part, model)):
                    values.append(evidence(n, found, model))
                    if passages:
                        strong = [(a, b, s, float(np.exp(log_e(s, n, model)))) for a, b, s in found]
                        f = int(w.first[d])
                        listed.append([{"low": a, "high": b, "score": s, "e_value": e, "passage": w.data[w.start[f + a] : w.end[f + b - 1]].decode()} for a, b, s, e in strong if e < SIGNIFICANT])
                out = [part.column("doc_id"), pa.array(model.probability(np.array(values)))]
                if passages:
                    out.append(pa.array(listed, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64()), ("passage", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "passages"][: len(out)])

    schema = "doc_id long, score double" + ", passages array<struct<low:int,high:int,score:double,e_value:double,passage:string>>" * passages
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id"), FOLDS) != 0)
    scored = score(docs, fit(docs, labels), passages=True)
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
