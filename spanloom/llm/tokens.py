"""Token counts by a two-tier lookup of pre-tokens.

Tier one is a broadcast table of the corpus's frequent pre-tokens with their lengths in tokens.  Each task
counts its own pre-tokens and reports those that are at least one in FREQUENT of them, so at most FREQUENT
rows; a pre-token as frequent in the whole corpus is as frequent in some task, and the table holds at most
FREQUENT entries.  Tier two is a cache in each Python worker, of bounded size, filled by encoding the
pre-tokens that miss.  Counts are sums over pre-tokens, so no text leaves its task, and neither the table nor
the cache changes a count.

Stretches between white space are independent of each other.  Those outside a safe range go to the library as
they are, so counts never depend on how closely this module's splitting follows the library's: any character
beyond Latin Extended-A, control or format characters, and whatever may hold a special token's string.

Defined cases: null reads as empty, with 0 bytes and tokens; repeated rows are counted each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter as Counts
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import cut, ship, table

from .text import pieces

NAME = "op5_token_counts"
ORACLE_SQL = None

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Entries of a worker's cache, which starts anew when full, and characters of the longest stretch it keeps.
CACHE_ENTRIES, CACHE_CHARS = 1_500_000, 64
#: A pre-token is frequent if it is at least one in so many.
FREQUENT = 10_000

#: Fixed value: how the word tokenizer splits normalised text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
#: Characters whose normalisation (NFC, lower case) is the same everywhere; U+0130 lower-cases to two.
UNSAFE = r"[^\t\n\r\x20-\x7e¡-¬®-įı-ſ]|<\|"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _range(kind: str) -> str:
    """The characters up to Latin Extended-A of a general category, as the inside of a character class."""
    return "".join(re.escape(c) for c in map(chr, range(0x180)) if unicodedata.category(c).startswith(kind))


SPLIT = re.compile(PRE_TOKEN.format(L=_range("L"), N=_range("N")))
_UNSAFE = re.compile(UNSAFE)
_STRETCH = re.compile(r"[^\t\n\x0b\x0c\r ]+")


def split(text: str) -> tuple[list[str], list[str]]:
    """Pre-tokens of the text's safe stretches, and its other stretches."""
    if not _UNSAFE.search(text):
        return SPLIT.findall(text.lower()), []
    safe, other = [], []
    for x in _STRETCH.findall(text):
        (other if _UNSAFE.search(x) else safe).append(x)
    return SPLIT.findall(" ".join(safe).lower()), other


class Counter:
    def __init__(self, path: str, common: dict[str, int], capacity: int = CACHE_ENTRIES) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.common, self.capacity, self.cache, self.others = common, capacity, dict(common), {}

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))

    def lengths(self, pre_tokens: list[str]) -> list[int]:
        """Tokens of each pre-token: all are encoded as one text, with a space between, and told apart by the
        library's word numbers; one by one should it ever split them otherwise."""
        found = [i for i in self.library.encode(" ".join(pre_tokens), add_special_tokens=False).word_ids if i is not None]
        if found and found[-1] == len(pre_tokens) - 1:
            return np.bincount(found, minlength=len(pre_tokens)).tolist()
        return [self.whole(x) for x in pre_tokens]

    def count(self, text: str) -> int:
        found, other = split(text)
        n = sum(map(self.other, other))
        cache = self.cache
        try:
            return n + sum([cache[x] for x in found])
        except KeyError:
            pass
        if len(cache) > len(self.common) + self.capacity:
            cache = self.cache = dict(self.common)
        missing = [x for x in dict.fromkeys(found) if x not in cache]
        for at in range(0, len(missing), 500):
            cache.update(zip(part := missing[at : at + 500], self.lengths(part)))
        return n + sum([cache[x] for x in found])

    def other(self, stretch: str) -> int:
        if len(stretch) > CACHE_CHARS:
            return self.whole(stretch)
        if stretch not in self.others:
            if len(self.others) > self.capacity:
                self.others = {}
            self.others[stretch] = self.whole(stretch)
        return self.others[stretch]


def _often(counts: Counts, share: int) -> list[tuple[str, int]]:
    least = -(-sum(counts.values()) // share)
    return [(x, n) for x, n in counts.items() if n >= least]


def frequent(docs: DataFrame, share: int = FREQUENT) -> list[str]:
    """Pre-tokens that are at least one in ``share`` of all reported ones, at most ``share`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counts = Counts()
        for batch in batches:
            for part in pieces(batch, "text"):
                for t in part.column("text").to_pylist():
                    counts.update(split(t or "")[0])
                if len(counts) > CACHE_ENTRIES:
                    # Memory stays bounded on long tasks: what is rare so far starts again.
                    counts = Counts(dict(_often(counts, 10 * share)))
        found = _often(counts, share)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    told = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    told = cut(told)
    total = told.agg(F.sum("n")).head()[0] or 0
    return sorted(r.word for r in told.where(F.col("n") * share >= total).collect())


def common_lengths(path: str, words: list[str]) -> dict[str, int]:
    """Each word's tokens."""
    counter = Counter(path, {})
    parts = [words[at : at + 500] for at in range(0, len(words), 500)]
    return {x: n for part in parts for x, n in zip(part, counter.lengths(part))}


#: The counter of the vocabulary and table last used in this worker, so that its cache outlives the task.
_COUNTERS: dict[tuple[str, int], Counter] = {}


def _counter(path: str, common: Broadcast) -> Counter:
    key = path, id(common.value)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(path, common.value)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer_path(tokenizer)
    common = spark.sparkContext.broadcast(common_lengths(path, frequent(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, common)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                n = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
