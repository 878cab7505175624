"""A small corpus with every odd case, as tables on disk."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in that with for this from which would there their about other could these people".split()
DE = "der die und das nicht mit ein sich auf für ist dem des eine über werden durch haben schön straße".split()
INSULTS = "moronic blockhead dimwit".split()


def prose(rng, words, n):
    # Two thirds common words, the rest made up of syllables, so that long word runs do not repeat by chance.
    syllable = ["ra", "ne", "ti", "lo", "mu", "sen", "dor", "vik"] if words is EN else ["ung", "keit", "sch", "ber", "ge", "ver", "lich", "zu"]
    return " ".join(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice(syllable) for _ in range(rng.randrange(2, 5))) for _ in range(n))


def corpus(seed=0, n=120):
    """Rows of documents, labels and benchmark."""
    rng = random.Random(seed)
    items = [prose(rng, EN, rng.randrange(14, 45)) for _ in range(8)] + ["short item of five words", None, ""]
    passage = prose(rng, EN, 60)
    docs, labels = [], []
    for i in range(n):
        german = i % 3 == 0
        text = prose(rng, DE if german else EN, rng.choice([1, 3, 12, 40, 150, 400]))
        toxic = 0
        if i % 4 == 1:
            w = text.split()
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w) + 1), rng.choice(INSULTS))
            text, toxic = " ".join(w), 1
        if i % 10 == 3:
            w = text.split()
            w[len(w) // 2 : len(w) // 2] = passage.split()
            text = "\n ".join(w)
        if i % 15 == 7:
            text = f"{text}\n{items[i % 8].upper()}, {text}"
        if i % 9 == 8 and docs:
            text = docs[-1][1]
        docs.append((i, text, "de" if german else "en", f"s{i % 5}" if i % 2 else "hot", len(text)))
        labels.append((i, i % 2, toxic))
    odd = [
        (1000, None, "en", "hot", None), (1001, "", "en", None, 0), (1002, " \t\n\r ", None, "s1", 5), (1003, "1234 !!! ---", None, "s1", 12), (1004, "ÄÖÜ ÉÉ <|endoftext|> x", "de", "s2", 22),
        (1005, "the " * 3000, "en", "s2", 12000), (1006, "x" * 50000, "en", "s3", 50000), (1007, prose(rng, EN, 4000), "en", "s3", 1), (1008, "漢字 かな 한글 привет мир", None, "s4", 3), (1009, "a\u00a0b\u2003c e\u0301 İ", "en", "s4", 1),
        (1010, "Licensed under CC BY-NC 4.0.", "en", "s1", 1), (1011, "Released under the MIT License.\n" + prose(rng, EN, 30), "en", "s1", 1),
    ]
    docs += odd
    docs += [docs[5], docs[5]]  # repeated rows
    return docs, labels + [(1000, None, None), (None, 1, 1), (5, 1, 0), (9999, 0, 1)], list(enumerate(items))


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    docs, labels, items = corpus()
    # Further columns with the names that operators use inside.
    extra = ", ".join(f"'{c}' AS {c}" for c in ("size", "target", "taken", "fp", "key", "root", "component_id", "bucket", "place", "guest", "spans", "names", "path", "row", "score", "label"))
    spark.createDataFrame(docs, DOCS).selectExpr("*", *extra.split(", ")).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    pages = [
        (0, "http://A.Example.NET/en/1?page=2&ref=x"), (1, "https://example.net/de/3"), (2, "https://spam-farm.example.org/en/728?utm_source=feed"), (3, "https://www.spam-farm.example.org/en/728/"), (4, None), (5, "no scheme"), (6, "://"),
        (7, "http://notexample.net/en/"), (8, "http://b.example.com/de/x#top"), (9, "ftp://x.org/fr/"), (10, "http://x.org/fr"), (11, "http://u://v.net/"), (12, "HTTP://NET/"), (None, "http://net"), (2, "https://spam-farm.example.org/en/728?utm_source=feed"), (13, ""),
    ]
    spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'h' AS host", "'v' AS verdict", "'c' AS canon").write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return str(root)
