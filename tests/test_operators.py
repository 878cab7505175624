"""DataFrame operators on small supersets, against kernels and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import graph, heuristics, isa
from spanloom.functions.heuristics import Options
from spanloom.operators import closure, invariants, metrics, relations, work
from spanloom.operators.superset import Superset, decode, decode_at, per_image, scan, trimmed
from spanloom.sources import images, sinks


@pytest.fixture(scope="module")
def source(spark):
    rng = random.Random(3)
    rows = [(i, bytearray(rng.randrange(256) for _ in range(n))) for i, n in enumerate([0, 1, 5, 40, 200, 200, 999])]
    return spark.createDataFrame([*rows, (7, None)], "image_id long, bytes binary")


def pairs(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def kernel(source):
    rows = [(r.image_id, bytes(r.bytes)) for r in source.collect() if r.bytes is not None]
    ids = np.array([i for i, _ in rows])
    g = graph.build(isa.t8(b"".join(b for _, b in rows), np.cumsum([0, *(len(b) for _, b in rows)])))
    return ids, g


def nodes(ids, g, mask):
    return set(zip(ids[g.image[mask]].tolist(), g.addr[mask].tolist()))


def test_scan_matches_kernel(spark, source):
    ids, g = kernel(source)
    s = scan(source)
    assert pairs(s.vertex, "image_id", "addr") == nodes(ids, g, g.vertex)
    assert pairs(s.edge, "image_id", "src", "dst") == set(zip(ids[g.image[g.src]].tolist(), g.addr[g.src].tolist(), g.addr[g.dst].tolist()))
    assert s.edge.count() == s.edge.distinct().count()
    assert decode(source, skip_first=True).where("addr = 1").count() == 0


def test_invariants_and_trim_agree(spark, source):
    ids, g = kernel(source)
    s = invariants.tagged(scan(source))
    tagged = graph.tag(g)
    assert pairs(s.bad, "image_id", "addr") == nodes(ids, tagged, tagged.bad)
    after = tagged.trim()
    for how in (closure.grouped, closure.looped):
        t = closure.trim(s, how)
        assert pairs(t.vertex, "image_id", "addr") == nodes(ids, after, after.vertex)
        assert pairs(t.insn, "image_id", "addr") == nodes(ids, after, after.row)
    assert pairs(trimmed(source).insn, "image_id", "addr") == nodes(ids, after, after.row)


def test_relations_match_kernel(spark, source):
    ids, g = kernel(source)
    g, s = graph.tag(g).trim(), trimmed(source)
    for df, mask in (
        (relations.entries(s), g.entries()), (relations.fronds(s), g.fronds()), (relations.branches(s), g.branches()), (relations.conflict_set(s), g.conflicts(g.row)),
        (relations.free_insns(s), g.free()), (relations.callsites(relations.callers(s), 0), g.callsites(0)), (relations.callsites(relations.callers_of_rows(s.insn), 0), g.callsites(0)), (relations.constants(s, decode(source)).select("image_id", F.col("value").alias("addr")), heuristics.constants(g)),
    ):
        assert pairs(df, "image_id", "addr") == nodes(ids, g, mask)
    assert pairs(relations.edge_list(s), "image_id", "src", "dst") == pairs(s.edge, "image_id", "src", "dst") | {(i, a, a) for i, a in nodes(ids, g, g.vertex & (g.in_degree() + g.out_degree() == 0))}


def test_set_primitives(spark, source):
    s = trimmed(source)
    some = s.vertex.where("addr % 2 = 0")
    marked = s.vertex_bad(some.unionByName(spark.createDataFrame([(0, 12345)], "image_id long, addr long")))
    assert pairs(marked.bad, "image_id", "addr") == pairs(some, "image_id", "addr")
    assert marked.clear_all_bad().bad.count() == 0 and marked.clear_bad(some).bad.count() == 0
    left = s.remove(some)
    assert left.vertex.where("addr % 2 = 0").count() == 0 and left.edge.where("src % 2 = 0 OR dst % 2 = 0").count() == 0
    assert pairs(left.add(s.insn).insn, "image_id", "addr") == pairs(s.insn, "image_id", "addr")
    new = spark.createDataFrame([(6, 70000, 70001)], "image_id long, src long, dst long")
    linked = s.link(new).link(new)
    assert linked.edge.count() == s.edge.count() + 1 and linked.unlink(new).edge.count() == s.edge.count()
    assert pairs(linked.unlink(new).vertex, "image_id", "addr") >= {(6, 70000), (6, 70001)}


def test_cached_addresses_decode_again(spark, source):
    s = trimmed(source)
    assert pairs(decode_at(source, s.vertex), "image_id", "addr") == pairs(s.vertex, "image_id", "addr")


def test_balance(spark, source):
    s = scan(source)
    lossy = Superset(s.insn.where("addr % 3 <> 0"), s.edge, s.vertex, s.bad)
    diff = relations.unbalanced(lossy)
    back = relations.rebalance(lossy, images.segments(source))
    assert pairs(back.bad, "image_id", "addr") == {r for r in pairs(s.insn, "image_id", "addr") if r[1] % 3 == 0}
    assert diff.where("side = 'map'").count() == 0


def test_evidence_and_distributions(spark):
    at = lambda rows: spark.createDataFrame(rows, "image_id long, addr long")
    rows = metrics.evidence({"Clamped": at([(1, 1), (1, 2)]), "Liveness": at([(1, 2)])})
    assert pairs(metrics.totals(rows, 2), "addr", "total") == {(2, 3)}
    assert pairs(metrics.distributions(rows, at([(1, 2)]), 99), "feature", "bucket", "tp", "fp") == {("Clamped", 2, 1, 1), ("Liveness", 1, 1, 0)}
    values = spark.createDataFrame([(1.0,), (3.0,)], "value double")
    assert metrics.deviation(values, 2.0).head()[0] == pytest.approx(2**0.5)


def test_summary_is_consistent(spark, source):
    full = metrics.run_summary(source, Options())
    for r in full.collect():
        assert r.true_positives + r.false_negatives >= r.n_entrances
        assert r.survivors >= r.true_positives and r.n_clean <= r.n_entrances
    early = metrics.run_summary(source, Options(compat=True)).agg(F.sum("survivors")).head()[0]
    assert early >= full.agg(F.sum("survivors")).head()[0]


def test_text_forms(spark, source, tmp_path):
    s = trimmed(source.where("image_id = 4"))
    sinks.graph_lines(s).select("line").write.text(str(tmp_path / "g"))
    assert pairs(images.parse_graph(spark, str(tmp_path / "g")), "src", "dst") == pairs(relations.edge_list(s), "src", "dst")
    assert sinks.dot_lines(s, {"red": s.vertex}).where("line LIKE '%red%'").count() == s.vertex.count()
    rows = spark.createDataFrame([(1, 5, None)], "image_id long, a long, b long")
    assert sinks.format_metrics(rows, "%1/%2", ["a", "b"]).head().text == "5/unknown"
    many = spark.createDataFrame([(1, *range(10))], "image_id long, " + ", ".join(f"m{k} long" for k in range(10)))
    assert sinks.format_metrics(many, "%1 %10", [f"m{k}" for k in range(10)]).head().text == "0 9"
    with pytest.raises(ValueError):
        sinks.format_metrics(rows, "%1", ["zzz"])


def test_cache(spark, source, tmp_path):
    cache = sinks.Cache(spark, str(tmp_path))
    done = sinks.digests(source.where("image_id < 3"), Options())
    cache.save("runs", done)
    assert cache.missing("runs", sinks.digests(source.where("bytes IS NOT NULL"), Options()).select("digest")).count() == 4
    cache.reset("runs")
    assert not (tmp_path / "runs").exists()


def test_rollup(spark):
    rows = spark.createDataFrame([(1, 2, 10), (2, None, 5), (3, 4, 30)], "image_id long, false_negatives long, occlusive_space long")
    assert tuple(sinks.corpus_rollup(rows).head()) == (6, 20.0, 2)
    assert tuple(sinks.corpus_rollup(rows, compat=True).head()) == (6, 3.0, 2)


def test_files_and_symbols(spark, tmp_path):
    (tmp_path / "bin" / "deep").mkdir(parents=True)
    (tmp_path / "bin" / "deep" / "a.bin").write_bytes(b"abc")
    assert images.from_files(spark, str(tmp_path / "bin")).head().n_bytes == 3
    (tmp_path / "s.txt").write_text("(main 0x10 0x20)\n(f 30 4)\njunk\n")
    assert pairs(images.symbols(spark, str(tmp_path / "s.txt")), "name", "addr", "size") == {("main", 16, 32), ("f", 48, 4)}


@pytest.mark.parametrize("seed", range(4))
def test_nearest_work(spark, seed):
    rng = random.Random(seed)
    tasks = [(f"t{k}", round(rng.random() * 9, 1)) for k in range(rng.randrange(1, 20))]
    hosts = [(f"h{k}", round(rng.random() * 12 - 1, 1)) for k in range(8)] + [("none", None)]
    got = {r.hostname: (r.size, r.fname) for r in work.nearest(spark.createDataFrame(hosts, "hostname string, want double"), spark.createDataFrame(tasks, "fname string, size double")).collect()}
    for h, want in hosts[:-1]:
        size = min({s for _, s in tasks}, key=lambda s: (round(abs(s - want), 9), s))
        assert abs(abs(got[h][0] - want) - abs(size - want)) < 1e-9 and got[h][1] == max(n for n, s in tasks if s == got[h][0])
    assert "none" not in got


def test_memory_model(spark):
    row = spark.range(1).select(
        work.size_key(F.lit(3 << 20)).alias("whole"), work.size_key(F.lit((1 << 20) + (1 << 19))).alias("part"),
        work.capacity(F.lit(80000.0), F.lit(24), F.lit(0.0), F.lit(0)).alias("fits"), work.capacity(F.lit(1000.0), F.lit(24), F.lit(0.0), F.lit(0)).alias("small"),
        work.capacity(F.lit(80000.0), F.lit(0), F.lit(0.0), F.lit(0)).alias("cores"), work.capacity(F.lit(80000.0), F.lit(24), F.lit(0.0), F.lit(4)).alias("busy"),
    ).head()
    assert row.whole == 3.0 and row.part == 2.5 and row.fits == 78.125
    assert row.small is None and row.cores is None and row.busy is None
    sent = spark.sql("SELECT 'a' AS fname, timestamp'2020-01-01 00:00:00' AS sent_at UNION ALL SELECT 'b', timestamp'2020-01-01 01:00:00'")
    assert [r.fname for r in work.overdue(sent, F.expr("timestamp'2020-01-01 01:10:00'")).collect()] == ["a"]


def test_stream(spark, source, tmp_path):
    from spanloom.streaming.ingest import receive

    source.where("bytes IS NOT NULL").coalesce(1).write.parquet(str(tmp_path / "in"))
    receive(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()}
    assert got == {tuple(r) for r in metrics.run_summary(source, Options()).collect()}


def test_step_by_image_equals_whole(spark, source):
    """Images do not influence each other, however they are dealt."""
    count = lambda df: pairs(per_image(df, lambda g: {"image": g.image[g.vertex], "addr": g.addr[g.vertex]}, "addr long"), "image_id", "addr")
    assert count(source) == count(source.repartition(5))


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    """Small turns in a small file, though of a row for every byte."""
    rng = random.Random(5)
    root = str(tmp_path_factory.mktemp("turns"))
    text = lambda n: "".join(rng.choice("abcdefgh klmnop\nqrstuvwxyz.,!0123\x05") for _ in range(n))
    spark.createDataFrame([(k, 0, "user", text(60)) for k in range(30)], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return root


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cross_section_of_any_segments(spark, source):
    """Against plain Python, with segments that overlap, that leave gaps and that some images lack."""
    rng = random.Random(7)
    s = scan(source)
    segments = [(i, k, low, low + rng.randrange(30)) for i in range(2, 6) for k, low in enumerate(rng.sample(range(1, 190), 9))] + [(3, None, 4, 9)]
    length = {(r.image_id, r.addr): r.len for r in s.insn.collect()}
    want = {}
    for i, src, dst in pairs(s.edge, "image_id", "src", "dst"):
        falls = src + length.get((i, src), 0) == dst or dst + length.get((i, dst), 0) == src
        a, b = ([k for j, k, low, high in segments if j == i and low <= x <= high] or [None] for x in (src, dst))
        if falls and any(x is None or y is None or x != y for x in a for y in b):
            want[i, src] = max(dst, want.get((i, src), dst))
    got = relations.cross_section(s, spark.createDataFrame(segments, "image_id long, seg_id int, low long, high long"))
    assert pairs(got, "image_id", "src", "dst") == {(*k, v) for k, v in want.items()} and want


@pytest.mark.parametrize("name", ["cross_section", "rebalance", "discard_by_joins", "fall_through_by_joins", "conflicts_by_joins"])
def test_rows_made_of_bytes_do_not_pass_the_driver(spark, turns, name):
    from spanloom.plans import catalog

    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, turns))


def test_edges_are_discarded_by_one_join(spark, source):
    """Also edges without a row at their source, which stay."""
    s = scan(source).link(spark.createDataFrame([(6, 70000, 70001), (6, 70000, 70000)], "image_id long, src long, dst long"))
    calls = {(r.image_id, r.addr): r.addr + r.len for r in s.insn.where("kind = 'call'").collect()}
    kept = relations.discard_edges(s)
    assert pairs(kept, "image_id", "src", "dst") == {e for e in pairs(s.edge, "image_id", "src", "dst") if calls.get(e[:2], e[2]) == e[2]}
    assert plan(relations.discard_edges(trimmed(source))).count("SortMergeJoin") == 1


#: Queries over whole documents that need no shuffle, as images do not depend on each other.
LOCAL = ["unbalanced_diff", "free_insns", "evidence", "evidence_total", "induced_subgraph", "isg_dot_judged", "conflicts_all", "isg_dot", "parent_conflicts"]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Documents in as many partitions as there are cores, which are not dealt anew."""
    rng = random.Random(6)
    root = str(tmp_path_factory.mktemp("docs"))
    text = lambda n: "".join(rng.choice("abcdefgh klmnop\nqrstuvwxyz.,!0123\x05") for _ in range(n))
    spark.createDataFrame([(k, text(60)) for k in range(40)], "doc_id long, text string").repartition(8).write.parquet(f"{root}/documents.parquet")
    return root


@pytest.mark.parametrize("name", LOCAL)
def test_documents_are_not_shuffled(spark, documents, name):
    from spanloom.plans import catalog

    assert "Exchange" not in plan(catalog.QUERIES[name](spark, documents))


def test_unbalanced_rows_match_joins(spark, source):
    """A jump out of the image is a vertex without a row; nothing of a trimmed graph is."""
    from spanloom.operators.superset import unbalanced_rows

    assert pairs(unbalanced_rows(source), "image_id", "addr", "side") == pairs(relations.unbalanced(scan(source)), "image_id", "addr", "side") != set()
    assert unbalanced_rows(source, invariants=tuple(graph.INVARIANTS)).count() == 0


def feature_sets(spark, source):
    """The features by joins."""
    s = trimmed(source)
    of = lambda name: metrics.node_sets(source, heuristics.EXTRACTORS[name])
    return {**{n: of(n) for n in ("NoExit", "Liveness", "LoopsWithBreak", "Callsites3")}, "FixpointGrammar": relations.branches(s), "Clamped": relations.free_insns(s), "ImgEntry": s.insn.where("addr = 1")}


def test_distributions_of_images_match_joins(spark, source):
    """Features as sets of rows, judged by joins; also at a threshold below a feature's points."""
    features = feature_sets(spark, source)
    truth = metrics.node_sets(source, lambda g: g.close(metrics.entrances_of(g), forward=True), prepared=False)
    for threshold in (99, 1):
        got = metrics.image_distributions(source, tuple(features), threshold)
        want = metrics.distributions(metrics.evidence(features), truth, threshold)
        assert pairs(got, "feature", "bucket", "tp", "fp") == pairs(want, "feature", "bucket", "tp", "fp") != set()
    assert plan(got).count("Exchange") == 1 and "Join" not in plan(got)


def test_evidence_of_images_matches_joins(spark, source):
    features = feature_sets(spark, source)
    got = metrics.image_evidence(source, tuple(features))
    assert pairs(got, *got.columns) == pairs(metrics.evidence(features), *got.columns) != set()


def test_rebalance_marks_once_and_within_segments(spark, source):
    """Segments that overlap or leave vertices out, and a mark that is there already; one join looks rows up."""
    s = scan(source)
    lossy = Superset(s.insn.where("addr % 3 <> 0"), s.edge, s.vertex, s.vertex.where("image_id = 4 AND addr IN (3, 5)"))
    back = relations.rebalance(lossy, spark.createDataFrame([(4, 1, 20), (4, 10, 30), (5, 50, 60)], "image_id long, low long, high long"))
    want = {(4, a) for a in range(3, 31, 3)} | {(5, a) for a in range(51, 61, 3)} | {(4, 5)}
    assert sorted(map(tuple, back.bad.select("image_id", "addr").collect())) == sorted(want)
    assert plan(back.bad).count("SortMergeJoin") == 2


def test_totals_of_images_match_joins(spark, source):
    features = feature_sets(spark, source)
    for threshold in (0, 2, 5):
        got = metrics.image_totals(source, tuple(features), threshold)
        assert pairs(got, *got.columns) == pairs(metrics.totals(metrics.evidence(features), threshold), *got.columns) != set()


def test_edges_among_nodes_match_joins(spark, source):
    from spanloom.operators.superset import edge_rows

    s = trimmed(source)
    got = edge_rows(source, invariants=tuple(graph.INVARIANTS), among=lambda g: g.free())
    assert pairs(got, "image_id", "src", "dst") == pairs(relations.induced(s.edge, relations.free_insns(s)), "image_id", "src", "dst") != set()


def test_judged_lines_of_images_match_joins(spark, source):
    truth = lambda g: g.close(metrics.entrances_of(g), forward=True)
    s = trimmed(source)
    rows = sorted(map(tuple, sinks.image_dot_lines(source, truth).collect()))
    judged = sinks.judged_dot_lines(s, metrics.node_sets(source, truth, prepared=False).join(s.vertex, ["image_id", "addr"], "left_semi"))
    assert rows == sorted(map(tuple, judged.collect())) != []


def test_addresses_of_any_origin_decode_again(spark, source):
    """Repeated, unmapped, null and far addresses, in many batches; images of one id are all read; only bitmaps and
    images are dealt by id."""
    rng = random.Random(8)
    some = [(i, rng.randrange(-5, 1100)) for i in range(9) for _ in range(300)] + [(6, 1 << 32), (6, -(1 << 32)), (None, 3), (4, None)]
    addrs = spark.createDataFrame(some, "image_id long, addr long").repartition(3)
    twice = source.unionByName(source.where("image_id = 4"))
    for images_ in (source, twice):
        want = sorted(tuple(r) for r in decode(images_).collect() if (r.image_id, r.addr) in set(some))
        assert sorted(map(tuple, decode_at(images_, addrs).select(decode(images_).columns).collect())) == want != []
    assert decode_at(source, addrs.limit(0)).count() == 0
    assert "addr" not in "".join(x for x in plan(decode_at(source, addrs)).splitlines() if "Exchange" in x)


def test_plain_lines_of_images_match_joins(spark, source):
    assert sorted(map(tuple, sinks.image_dot_lines(source).collect())) == sorted(map(tuple, sinks.dot_lines(trimmed(source)).collect())) != []


def test_parent_conflicts_of_images_match_joins(spark, source):
    from spanloom.operators.superset import parent_conflict_rows

    got = parent_conflict_rows(source, invariants=tuple(graph.INVARIANTS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, relations.parent_conflicts(trimmed(source)).collect())) != []
