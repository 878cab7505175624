"""Every registered query of the engine on small tables, against its SQL."""

import random

import duckdb
import pytest

from spanloom.plans import catalog


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    root = tmp_path_factory.mktemp("small")
    text = lambda n: "".join(rng.choice("abcdefghij klmnop\nqrstuvwxyzéüßABC.,!0123\x05\x0f~") for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 7, 60, 250])), "en", "s", 0) for i in range(40)] + [(99, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, "u", text(80)) for i in range(10)] + [(77, "u", None)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(i // 3, i % 3, "user", text(rng.choice([3, 50, 120]))) for i in range(20)], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return str(root)


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rounded(tuple(r) for r in df.select(columns).collect())
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
        want = con.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == columns
        assert got == rounded(want.project(", ".join(columns)).fetchall())


def test_plans_scan_only_what_they_use(spark, sf_dir):
    """Decoding reads two columns and shuffles nothing but a small scan's own rows."""
    plan = catalog.flagship(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("Exchange hashpartitioning(image_id") == 1 and "Join" not in plan


def test_commands(spark, tmp_path, capsys):
    from spanloom.__main__ import main

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.bin").write_bytes(bytes(random.Random(k).randrange(256) for _ in range(100)))
    cache = ["--cache", str(tmp_path / "cache")]
    assert main(["run", str(tmp_path / "in"), *cache], spark) == 0
    main(["metrics", *cache, "--format", "%1 bytes,size"], spark)
    main(["cache", *cache, "--verify", str(tmp_path / "in")], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[1:4] == ["100 bytes"] * 3 and out[4] == "0"
    main(["cache", *cache, "--reset"], spark)
    assert not (tmp_path / "cache" / "metrics").exists()
