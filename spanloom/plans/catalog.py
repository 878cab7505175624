"""Registered queries over whole tables, and their DuckDB equivalents.

Images are the UTF-8 bytes of whole texts: ``documents`` unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import graph, heuristics, walks
from spanloom.functions.heuristics import Options
from spanloom.operators import closure, invariants, metrics, relations, work
from spanloom.operators.superset import Superset, body_bytes, conflict_rows, decode, edge_rows, parent_conflict_rows, scan, trimmed, trimmed_rows, unbalanced_rows
from spanloom.sources import images, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- shared SQL

_CORPUS_SQL = {
    "documents": "SELECT doc_id AS image_id, text FROM documents WHERE text IS NOT NULL",
    "pages": "SELECT page_id AS image_id, html AS text FROM pages WHERE html IS NOT NULL",
    "conversations": "SELECT conv_id * 1000 + turn AS image_id, text FROM conversations WHERE text IS NOT NULL",
}


def _base(corpus: str) -> str:
    """Candidates, edges and vertices of the synthetic instruction set."""
    return f"""
WITH RECURSIVE src AS ({_CORPUS_SQL[corpus]}),
hx AS (SELECT image_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM src),
by0 AS (SELECT image_id, len(l) AS n, unnest(l) AS x, generate_subscripts(l, 1) AS addr FROM hx),
by1 AS (SELECT image_id, n, addr, ('0x' || x)::INT AS b FROM by0),
by2 AS (SELECT *, CASE WHEN (b // 4) % 8 = 4 OR addr + b % 4 > n THEN 'invalid' ELSE (['ret','jmp','cond','call','invalid','seq','seq','seq'])[(b // 4) % 8 + 1] END AS kind FROM by1),
by3 AS (SELECT *, CASE WHEN kind = 'invalid' THEN 1 ELSE 1 + b % 4 END AS len FROM by2),
insn AS MATERIALIZED (
  SELECT image_id, addr::BIGINT AS addr, len::INT AS len, kind <> 'invalid' AS valid, kind,
         CASE WHEN kind IN ('cond','call','seq') THEN addr + len END::BIGINT AS fall,
         CASE WHEN kind IN ('jmp','cond','call') THEN addr + len + (b * 37) % 41 - 20 END::BIGINT AS jump,
         n::BIGINT AS n, b::BIGINT AS word,
         CASE WHEN kind = 'invalid' THEN 0 ELSE 1 << (b % 8) END::INT AS defs, CASE WHEN kind = 'invalid' THEN 0 ELSE 1 << ((b // 8) % 8) END::INT AS uses
  FROM by3
),
tgt AS (SELECT image_id, n, len, addr AS src, fall AS dst FROM insn WHERE fall IS NOT NULL UNION SELECT image_id, n, len, addr, jump FROM insn WHERE jump IS NOT NULL),
edge AS MATERIALIZED (SELECT image_id, src, dst FROM tgt),
vertex AS (SELECT image_id, addr FROM insn UNION SELECT image_id, dst FROM edge)"""


_MARKS = """,
bad AS (
  SELECT image_id, addr FROM insn WHERE NOT valid
  UNION SELECT image_id, dst FROM tgt WHERE dst < 1 OR dst > n
  UNION SELECT image_id, dst FROM tgt WHERE dst = 0
  UNION SELECT image_id, src FROM tgt WHERE dst > src AND dst < src + len
)"""

_DEAD = """,
dead AS (SELECT image_id, addr FROM bad UNION SELECT e.image_id, e.src FROM edge e JOIN dead d ON e.image_id = d.image_id AND e.dst = d.addr),
live AS (SELECT * FROM insn ANTI JOIN dead USING (image_id, addr)),
ledge AS (SELECT edge.* FROM edge SEMI JOIN live ON edge.image_id = live.image_id AND edge.src = live.addr),
lbody AS (SELECT image_id, addr AS owner, unnest(generate_series(addr + 1, addr + len - 1)) AS addr FROM live WHERE len > 1),
lconf AS (SELECT b.* FROM lbody b SEMI JOIN live USING (image_id, addr)),
cset AS (SELECT image_id, owner AS addr FROM lconf UNION SELECT image_id, addr FROM lconf),
free AS (SELECT image_id, addr FROM live ANTI JOIN cset USING (image_id, addr)),
deg AS (SELECT image_id, addr, sum(i) AS into_, sum(o) AS out_ FROM (SELECT image_id, src AS addr, 0 AS i, 1 AS o FROM ledge UNION ALL SELECT image_id, dst, 1, 0 FROM ledge) GROUP BY ALL),
caller AS (SELECT e.image_id, e.dst AS addr, e.src AS caller FROM ledge e JOIN live i ON e.image_id = i.image_id AND e.src = i.addr WHERE i.addr + i.len <> e.dst)"""


def _closure(name: str, seeds: str, forward: bool, edge: str = "ledge") -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f""",
{name} AS ({seeds} UNION SELECT e.image_id, e.{b} FROM {edge} e JOIN {name} c ON e.image_id = c.image_id AND e.{a} = c.addr)"""


def _sql(body: str, stage: str = "live", corpus: str = "documents", extra: str = "") -> str:
    return _base(corpus) + {"scan": "", "marks": _MARKS, "live": _MARKS + _DEAD}[stage] + extra + "\n" + body


def _register(name: str, sql: str | None = None):
    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def _scan(spark: SparkSession, sf_dir: str, corpus: str = "documents") -> Superset:
    return scan(images.CORPORA[corpus](spark, sf_dir))


def _live(spark: SparkSession, sf_dir: str, corpus: str = "documents") -> Superset:
    return trimmed(images.CORPORA[corpus](spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors per image after decoding, tagging and trimming."""
    return trimmed_rows(images.documents(spark, sf_dir), ("len",)).groupBy("image_id").agg(F.count(F.lit(1)).alias("survivors"), F.sum("len").alias("len_sum"))


_register("trim_summary", _sql("SELECT image_id, count(*) AS survivors, sum(len)::BIGINT AS len_sum FROM live GROUP BY image_id"))(flagship)

# ---------------------------------------------------------------- scans

_ROW = "image_id, addr, len, valid, kind, fall, jump, n, word, defs, uses"


@_register("decode_all", _sql(f"SELECT {_ROW} FROM insn", "scan"))
def decode_all(spark, sf_dir):
    return decode(images.documents(spark, sf_dir))


@_register("decode_skip_first", _sql(f"SELECT {_ROW} FROM insn WHERE addr > 1", "scan", "conversations"))
def decode_skip_first(spark, sf_dir):
    return decode(images.conversations(spark, sf_dir), skip_first=True)


@_register("decode_pages", _sql("SELECT image_id, kind, count(*) AS n_rows, sum(len)::BIGINT AS len_sum FROM insn GROUP BY ALL", "scan", "pages"))
def decode_pages(spark, sf_dir):
    return decode(images.pages(spark, sf_dir)).groupBy("image_id", "kind").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("len").alias("len_sum"))


@_register("body_bytes", _sql("SELECT image_id, addr AS owner, unnest(generate_series(addr + 1, addr + len - 1)) AS addr FROM insn WHERE len > 1", "scan"))
def body_bytes_query(spark, sf_dir):
    return body_bytes(_scan(spark, sf_dir).insn)


@_register("edges", _sql("SELECT image_id, src, dst FROM edge", "scan"))
def edges(spark, sf_dir):
    return edge_rows(images.documents(spark, sf_dir))


@_register("edges_by_rows", _sql("SELECT image_id, src, dst FROM edge", "scan", "conversations"))
def edges_by_rows(spark, sf_dir):
    """The same off the rows of the map."""
    from spanloom.operators.superset import edges_of

    return edges_of(decode(images.conversations(spark, sf_dir)))


@_register("vertices", _sql("SELECT image_id, addr FROM vertex", "scan"))
def vertices(spark, sf_dir):
    return _scan(spark, sf_dir).vertex


@_register("transpose", _sql("SELECT image_id, dst AS src, src AS dst FROM edge", "scan", "conversations"))
def transpose(spark, sf_dir):
    return relations.transpose(_scan(spark, sf_dir, "conversations"))


@_register("image_stats", _sql("SELECT image_id, count(*) AS n_rows, min(addr) AS base, sum(len)::BIGINT AS len_sum, count(*) FILTER (NOT valid) AS n_invalid, max(n) AS total_bytes FROM insn GROUP BY image_id", "scan"))
def image_stats(spark, sf_dir):
    return relations.stats(_scan(spark, sf_dir).insn)


@_register("cached_rerun", _sql("SELECT image_id, src, dst FROM edge SEMI JOIN live ON edge.image_id = live.image_id AND edge.src = live.addr"))
def cached_rerun(spark, sf_dir):
    """The addresses of a trimmed graph, decoded again and only linked."""
    from spanloom.operators.superset import decode_at, edges_of

    source = images.documents(spark, sf_dir)
    return edges_of(decode_at(source, trimmed(source).vertex, fields=("addr", "fall", "jump")))


# ---------------------------------------------------------------- invariants

for _name, _says, _where in (
    ("inv_non_insn", "Tag non insn", "SELECT image_id, addr FROM insn WHERE NOT valid"),
    ("inv_target_not_in_mem", "Tag target not in mem", "SELECT DISTINCT image_id, dst AS addr FROM tgt WHERE dst < 1 OR dst > n"),
    ("inv_target_is_bad", "Tag target is bad", "SELECT DISTINCT image_id, dst AS addr FROM tgt WHERE dst = 0"),
    ("inv_target_in_body", "Tag target in body", "SELECT DISTINCT image_id, src AS addr FROM tgt WHERE dst > src AND dst < src + len"),
):
    _register(_name, _sql(_where, "scan"))(lambda spark, sf_dir, says=_says: invariants.REGISTRY[says](_scan(spark, sf_dir)))


@_register("inv_target_in_body_pages", _sql("SELECT DISTINCT image_id, src AS addr FROM tgt WHERE dst > src AND dst < src + len", "scan", "pages"))
def inv_target_in_body_pages(spark, sf_dir):
    """Over pages, whose slashes decode to calls into their own bodies."""
    return invariants.REGISTRY["Tag target in body"](_scan(spark, sf_dir, "pages"))


@_register("tagged", _sql("SELECT image_id, addr FROM bad", "marks", "conversations"))
def tagged(spark, sf_dir):
    return invariants.tagged(_scan(spark, sf_dir, "conversations")).bad


# ---------------------------------------------------------------- trim and closures


@_register("trim", _sql("SELECT image_id, addr, len, kind FROM live"))
def trim(spark, sf_dir):
    return trimmed_rows(images.documents(spark, sf_dir), ("addr", "len", "kind"))


@_register("trim_by_joins", _sql("SELECT image_id, addr FROM vertex ANTI JOIN dead USING (image_id, addr)", corpus="conversations"))
def trim_by_joins(spark, sf_dir):
    """The same by marks and closures over DataFrames, for supersets of any origin."""
    return closure.trim(invariants.tagged(_scan(spark, sf_dir, "conversations"))).vertex


@_register("closure_pred", _sql("SELECT image_id, addr FROM c", extra=_closure("c", "SELECT image_id, addr FROM deg WHERE out_ = 0 AND into_ > 0", False)))
def closure_pred(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: g.close(g.entries(), forward=False))


@_register("closure_succ", _sql("SELECT image_id, addr FROM c", extra=_closure("c", "SELECT image_id, addr FROM live WHERE addr = 1", True)))
def closure_succ(spark, sf_dir):
    s = _live(spark, sf_dir)
    return closure.grouped(s.edge, s.vertex.where("addr = 1"), True)


@_register("closure_looped", _sql("SELECT image_id, addr FROM c", extra=_closure("c", "SELECT image_id, addr FROM live WHERE addr = 1", True), corpus="conversations"))
def closure_looped(spark, sf_dir):
    s = _live(spark, sf_dir, "conversations")
    return closure.looped(s.edge, s.vertex.where("addr = 1"), True)


_BODIES = "SELECT DISTINCT b.image_id, b.addr FROM lconf b SEMI JOIN c ON b.image_id = c.image_id AND b.owner = c.addr"


@_register("mark_descendant_bodies", _sql(_BODIES, extra=_closure("c", "SELECT image_id, addr FROM live WHERE addr = 1", True)))
def mark_descendant_bodies(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: g.mark_bodies(heuristics.main_entry(g)).bad)


# ---------------------------------------------------------------- degrees and callers

_NODES = "SELECT image_id, addr FROM deg WHERE "


@_register("entries", _sql(_NODES + "out_ = 0 AND into_ > 0"))
def entries(spark, sf_dir):
    return relations.entries(_live(spark, sf_dir))


@_register("fronds", _sql(_NODES + "into_ = 0 AND out_ > 0"))
def fronds(spark, sf_dir):
    return relations.fronds(_live(spark, sf_dir))


@_register("mergers", _sql(_NODES + "into_ > 1"))
def mergers(spark, sf_dir):
    return relations.mergers(_live(spark, sf_dir))


@_register("branches", _sql(_NODES + "out_ >= 2"))
def branches(spark, sf_dir):
    return relations.branches(_live(spark, sf_dir))


@_register("isg_to_list", _sql("SELECT image_id, src, dst FROM ledge UNION ALL SELECT image_id, addr, addr FROM live ANTI JOIN deg USING (image_id, addr)"))
def isg_to_list(spark, sf_dir):
    return relations.edge_list(_live(spark, sf_dir))


@_register("callers", _sql("SELECT image_id, addr, caller FROM caller"))
def callers(spark, sf_dir):
    return relations.callers_of_rows(trimmed_rows(images.documents(spark, sf_dir), ("addr", "len", "jump")))


def _live_edges(spark, sf_dir) -> DataFrame:
    return relations.edges_with_fall(trimmed_rows(images.documents(spark, sf_dir), ("addr", "len", "kind", "fall", "jump")))


for _t in (0, 2, 4, 6):
    _register(f"callsites_t{_t}", _sql(f"SELECT image_id, addr, count(*) AS callers FROM caller GROUP BY ALL HAVING count(*) > {_t}"))(lambda spark, sf_dir, t=_t: relations.callsites(relations.callers_of_rows(trimmed_rows(images.documents(spark, sf_dir), ("addr", "len", "jump"))), t))


@_register("fall_through_edges", _sql("SELECT e.image_id, e.src, e.dst FROM ledge e JOIN live i ON e.image_id = i.image_id AND e.src = i.addr WHERE i.addr + i.len = e.dst"))
def fall_through_edges(spark, sf_dir):
    return _live_edges(spark, sf_dir).where("after = dst").select("image_id", "src", "dst")


@_register("non_fall_through_edges", _sql("SELECT image_id, caller AS src, addr AS dst FROM caller"))
def non_fall_through_edges(spark, sf_dir):
    return _live_edges(spark, sf_dir).where("after <> dst").select("image_id", "src", "dst")


@_register("non_fall_through_edges_compat", _sql("SELECT e.image_id, max(e.src) AS src, e.dst FROM ledge e JOIN live i ON e.image_id = i.image_id AND e.src = i.addr WHERE i.addr + i.len = e.dst GROUP BY e.image_id, e.dst"))
def non_fall_through_edges_compat(spark, sf_dir):
    return relations.non_fall_through_edges(_live(spark, sf_dir), compat=True)


@_register("discard_edges", _sql("SELECT e.image_id, e.src, e.dst FROM ledge e JOIN live i ON e.image_id = i.image_id AND e.src = i.addr WHERE i.kind <> 'call' OR i.addr + i.len = e.dst"))
def discard_edges(spark, sf_dir):
    return _live_edges(spark, sf_dir).where("kind <> 'call' OR after = dst").select("image_id", "src", "dst")


@_register("fall_through_by_joins", _sql("SELECT e.image_id, e.src, e.dst FROM ledge e JOIN live i ON e.image_id = i.image_id AND e.src = i.addr WHERE i.addr + i.len = e.dst", corpus="conversations"))
def fall_through_by_joins(spark, sf_dir):
    """The same for supersets of any origin, whose edges need not be those of their rows."""
    return relations.fall_through_edges(_live(spark, sf_dir, "conversations"))


@_register("discard_by_joins", _sql("SELECT e.image_id, e.src, e.dst FROM ledge e JOIN live i ON e.image_id = i.image_id AND e.src = i.addr WHERE i.kind <> 'call' OR i.addr + i.len = e.dst", corpus="conversations"))
def discard_by_joins(spark, sf_dir):
    return relations.discard_edges(_live(spark, sf_dir, "conversations"))


@_register("induced_subgraph", _sql("SELECT e.image_id, e.src, e.dst FROM ledge e SEMI JOIN free f ON e.image_id = f.image_id AND e.src = f.addr SEMI JOIN free h ON e.image_id = h.image_id AND e.dst = h.addr"))
def induced_subgraph(spark, sf_dir):
    """The graph of the instructions that overlap no other."""
    return edge_rows(images.documents(spark, sf_dir), invariants=tuple(graph.INVARIANTS), among=lambda g: g.free())


# ---------------------------------------------------------------- overlaps


@_register("conflicts", _sql("SELECT image_id, owner, addr FROM lconf"))
def conflicts(spark, sf_dir):
    return conflict_rows(images.documents(spark, sf_dir), invariants=tuple(graph.INVARIANTS))


@_register("conflicts_by_joins", _sql("SELECT image_id, owner, addr FROM lconf", corpus="conversations"))
def conflicts_by_joins(spark, sf_dir):
    """The same for maps of any origin."""
    return relations.conflicts(trimmed_rows(images.conversations(spark, sf_dir), ("addr", "len")))


@_register("conflicts_all", _sql("SELECT image_id, addr FROM cset"))
def conflicts_all(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: g.conflicts(g.row))


@_register("conflicts_within", _sql("SELECT image_id, owner AS addr FROM k UNION SELECT image_id, addr FROM k", extra=", k AS (SELECT c.* FROM lconf c SEMI JOIN (SELECT image_id, addr FROM deg WHERE out_ >= 2) b ON c.image_id = b.image_id AND c.owner = b.addr)"))
def conflicts_within(spark, sf_dir):
    """Conflicts of branches only."""
    s = _live(spark, sf_dir)
    return relations.conflict_set(s, relations.branches(s))


@_register("parent_conflicts", _sql("SELECT DISTINCT c.image_id, c.owner AS parent, c.addr FROM lconf c JOIN ledge a ON a.image_id = c.image_id AND a.src = c.addr JOIN ledge b ON b.image_id = c.image_id AND b.src = c.owner AND b.dst = a.dst"))
def parent_conflicts(spark, sf_dir):
    return parent_conflict_rows(images.documents(spark, sf_dir), invariants=tuple(graph.INVARIANTS))


@_register("free_insns", _sql("SELECT image_id, addr FROM free"))
def free_insns(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: g.free())


@_register("unbalanced_diff", _sql("SELECT image_id, addr, 'graph' AS side FROM vertex ANTI JOIN insn USING (image_id, addr)", "scan"))
def unbalanced_diff(spark, sf_dir):
    return unbalanced_rows(images.documents(spark, sf_dir))


_CUT = "SELECT image_id, addr FROM insn WHERE addr % 7 = 0"


@_register("rebalance", _sql(_CUT, "scan", "conversations"))
def rebalance(spark, sf_dir):
    """With the map rows of every seventh address lost, these are marked again: they are mapped vertices."""
    source = images.conversations(spark, sf_dir)
    s = scan(source)
    lossy = Superset(s.insn.where("addr % 7 <> 0"), s.edge, s.vertex, s.bad)
    return relations.rebalance(lossy, images.segments(source)).bad


@_register("constants", _sql("SELECT i.image_id, i.addr, i.word AS value FROM insn i SEMI JOIN live v ON i.image_id = v.image_id AND i.word = v.addr"))
def constants(spark, sf_dir):
    source = images.documents(spark, sf_dir)
    return relations.constants(trimmed(source), decode(source))


@_register("cross_section", _sql("""SELECT e.image_id, e.src, max(e.dst) AS dst FROM edge e JOIN insn i ON e.image_id = i.image_id AND e.src = i.addr LEFT JOIN insn j ON e.image_id = j.image_id AND e.dst = j.addr
WHERE (i.addr + i.len = e.dst OR e.dst + coalesce(j.len, 0) = e.src) AND (j.addr IS NULL OR (e.src <= i.n // 2) <> (e.dst <= i.n // 2)) GROUP BY e.image_id, e.src""", "scan", "conversations"))
def cross_section(spark, sf_dir):
    """Images are cut into two segments for this."""
    source = images.conversations(spark, sf_dir)
    return relations.cross_section(scan(source), images.segments(source, "half"))


# ---------------------------------------------------------------- heuristics

_ENTRY_CLOSURE = _closure("c", "SELECT image_id, addr FROM deg WHERE out_ = 0 AND into_ > 0", False)


@_register("exitless", _sql("SELECT image_id, addr FROM live ANTI JOIN c USING (image_id, addr)", extra=_ENTRY_CLOSURE))
def exitless(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), heuristics.exitless)


_FREE_CLOSURE = _closure("c", "SELECT image_id, addr FROM free", True)
_SPARED = _closure("p", "SELECT DISTINCT image_id, addr FROM caller", True)


@_register("trim_clamped", _sql("SELECT image_id, addr FROM m ANTI JOIN c USING (image_id, addr)", extra=_FREE_CLOSURE + f", m AS ({_BODIES})"))
def trim_clamped(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: heuristics.trim_clamped(g).bad)


@_register("trim_limited_clamped", _sql("SELECT image_id, addr FROM m ANTI JOIN c USING (image_id, addr) ANTI JOIN p USING (image_id, addr)", extra=_FREE_CLOSURE + _SPARED + f", m AS ({_BODIES})"))
def trim_limited_clamped(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: heuristics.trim_limited_clamped(g).bad)


@_register("callsite_lineage", _sql("SELECT image_id, addr FROM p", extra=_SPARED))
def callsite_lineage(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: g.close(g.callsites(0), forward=True))


@_register("branch_sweep", _sql("""SELECT image_id, addr FROM hits GROUP BY ALL HAVING sum(k) = 2""", extra=""",
jmp AS (SELECT e.image_id, e.dst AS child, max(e.src) AS top, list(e.src) AS tops FROM ledge e SEMI JOIN (SELECT image_id, addr FROM deg WHERE out_ >= 2) b ON e.image_id = b.image_id AND e.src = b.addr
        JOIN live i ON e.image_id = i.image_id AND e.dst = i.addr WHERE i.addr + i.len <> e.src GROUP BY e.image_id, e.dst),
top AS (SELECT DISTINCT image_id, unnest(tops) AS addr FROM jmp),
rest AS (SELECT e.* FROM ledge e ANTI JOIN jmp ON e.image_id = jmp.image_id AND e.dst = jmp.child AND e.src = jmp.top),
root AS (SELECT image_id, dst AS addr FROM rest GROUP BY ALL HAVING (image_id, dst) NOT IN (SELECT (image_id, src) FROM rest))""" + _closure("vis", "SELECT image_id, addr FROM root", False, "rest") + """,
met AS (SELECT image_id, addr, sum(k) AS k FROM (SELECT r.image_id, r.src AS addr, 1 AS k FROM rest r SEMI JOIN vis ON r.image_id = vis.image_id AND r.dst = vis.addr UNION ALL SELECT image_id, addr, 1 FROM root) GROUP BY ALL),
hits AS (SELECT image_id, addr, k FROM met SEMI JOIN top USING (image_id, addr) UNION ALL SELECT j.image_id, j.top, m.k FROM jmp j JOIN met m ON j.image_id = m.image_id AND j.child = m.addr)"""))
def branch_sweep(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), walks.branch_sweep)


_LIVE_ROWS = """,
bits AS (SELECT unnest(range(8)) AS v),
use_ AS (SELECT image_id, addr, v FROM live, bits WHERE (uses >> v) & 1 = 1),
lv AS (SELECT image_id, addr, v FROM use_ UNION SELECT e.image_id, e.src, l.v FROM lv l JOIN ledge e ON e.image_id = l.image_id AND e.dst = l.addr JOIN live i ON i.image_id = e.image_id AND i.addr = e.src WHERE (i.defs >> l.v) & 1 = 0)"""


@_register("liveness_rows", _sql("SELECT image_id, addr, 'r' || v AS var FROM lv", extra=_LIVE_ROWS))
def liveness_rows(spark, sf_dir):
    return metrics.live_rows(images.documents(spark, sf_dir))


@_register("liveness_addrs", _sql("SELECT DISTINCT image_id, addr FROM lv", extra=_LIVE_ROWS))
def liveness_addrs(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), heuristics.liveness)


@_register("linear_sweep", _sql("SELECT image_id, addr FROM sweep", "scan", extra=""", 
sweep AS (SELECT image_id, addr FROM insn WHERE addr = 1 UNION SELECT i.image_id, i.addr FROM sweep s JOIN insn p ON p.image_id = s.image_id AND p.addr = s.addr JOIN insn i ON i.image_id = p.image_id AND i.addr = p.addr + p.len)""", corpus="conversations"))
def linear_sweep(spark, sf_dir):
    return metrics.node_sets(images.conversations(spark, sf_dir), walks.linear_sweep, prepared=False)


# Every cycle has an edge that does not rise.  The targets of such edges are closed over both ways, and where both
# meet is their component; the least address names it.
_LOOPS = """,
fw AS (SELECT DISTINCT image_id, dst AS s, dst AS x FROM ledge WHERE dst <= src UNION SELECT f.image_id, f.s, e.dst FROM fw f JOIN ledge e ON e.image_id = f.image_id AND e.src = f.x),
bw AS (SELECT DISTINCT image_id, dst AS s, dst AS x FROM ledge WHERE dst <= src UNION SELECT f.image_id, f.s, e.src FROM bw f JOIN ledge e ON e.image_id = f.image_id AND e.dst = f.x),
scc AS (SELECT image_id, x AS addr, min(s) AS label FROM fw JOIN bw USING (image_id, s, x) GROUP BY ALL),
comp AS (SELECT image_id, addr, min(addr) OVER (PARTITION BY image_id, label) AS loop, count(*) OVER (PARTITION BY image_id, label) AS members FROM scc),
looped AS (SELECT * FROM comp WHERE members > 1)"""


@_register("loops", _sql("SELECT image_id, addr, loop, members FROM looped", extra=_LOOPS))
def loops(spark, sf_dir):
    return relations.loop_sizes(metrics.loops(images.documents(spark, sf_dir), 1))


@_register("loops_over_20", _sql("SELECT image_id, addr, loop FROM comp WHERE members > 20", extra=_LOOPS))
def loops_over_20(spark, sf_dir):
    return metrics.loops(images.documents(spark, sf_dir), heuristics.LOOP_SIZE)


@_register("loops_with_break", _sql("""SELECT a.image_id, a.addr FROM looped a SEMI JOIN (SELECT e.image_id, l.loop FROM ledge e JOIN looped l ON e.image_id = l.image_id AND e.src = l.addr
LEFT JOIN looped m ON e.image_id = m.image_id AND e.dst = m.addr WHERE m.loop IS DISTINCT FROM l.loop) b ON a.image_id = b.image_id AND a.loop = b.loop""", extra=_LOOPS))
def loops_with_break(spark, sf_dir):
    return metrics.node_sets(images.documents(spark, sf_dir), heuristics.loops_with_break)


@_register("loop_contradictions", _sql("""SELECT DISTINCT c.image_id, c.addr FROM lconf c SEMI JOIN looped l ON c.image_id = l.image_id AND c.owner = l.addr
SEMI JOIN (SELECT e.image_id, e.src FROM ledge e SEMI JOIN looped l ON e.image_id = l.image_id AND e.dst = l.addr) p ON c.image_id = p.image_id AND c.addr = p.src ANTI JOIN looped o ON c.image_id = o.image_id AND c.addr = o.addr""", extra=_LOOPS))
def loop_contradictions(spark, sf_dir):
    """With loops of more than one member, as the images have few over twenty."""
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: heuristics.loop_contradictions(g, 1).bad)


@_register("loop_parents", _sql("SELECT DISTINCT e.image_id, e.src AS addr FROM ledge e SEMI JOIN looped l ON e.image_id = l.image_id AND e.dst = l.addr ANTI JOIN looped o ON e.image_id = o.image_id AND e.src = o.addr", extra=_LOOPS))
def loop_parents(spark, sf_dir):
    source = images.documents(spark, sf_dir)
    return relations.parents_outside(trimmed(source).edge, metrics.loops(source, 1).select("image_id", "addr"))


for _name, _of in {
    "restricted_clamp": walks.restricted_clamp,
    "extended_clamp": walks.extended_clamp,
    "identify_branches": walks.identify_branches,
    "grammar_convergent": lambda g: walks.grammar_convergent(g.mark(g.conflicts(g.row))).bad,
    "descendant_features": lambda g: walks.descendant_features(g, g.branches(), 2),
    "trim_branch_descendants": lambda g: heuristics.trim_descendant_features(g, lambda x: x.branches(), 10).bad,
    "running_evidence": lambda g: walks.running_evidence(g, 2 * g.branches().astype(int)) > 20,
}.items():
    _register(_name)(lambda spark, sf_dir, of=_of: metrics.node_sets(images.documents(spark, sf_dir), of))


_OLD = ("FixpointGrammar", "FixpointFreevarSSA", "Clamped", "Constant", "ImgEntry")

for _name, _of in {
    "definers": walks.definers,
    "trim_definer_descendants": lambda g: heuristics.trim_descendant_features(g, walks.definers, 1).bad,
    "old_generation_marks": lambda g: heuristics.apply_old_features(g, _OLD).bad,
    "old_generation_round": lambda g: heuristics.one_round(g, ("DiscardEdges", "ImgEntry", "TrimFixpointGrammar", "TrimFixpointSSA"), heuristics.OLD_MARKERS).row,
}.items():
    _register(_name)(lambda spark, sf_dir, of=_of: metrics.node_sets(images.documents(spark, sf_dir), of))


@_register("trim_branch_lineage", _sql("SELECT DISTINCT b.image_id, b.addr FROM lconf b SEMI JOIN (SELECT * FROM c ANTI JOIN p USING (image_id, addr)) w ON b.image_id = w.image_id AND b.owner = w.addr ANTI JOIN c x ON b.image_id = x.image_id AND b.addr = x.addr ANTI JOIN p y ON b.image_id = y.image_id AND b.addr = y.addr", extra=_closure("c", "SELECT image_id, addr FROM deg WHERE out_ >= 2", True) + _SPARED))
def trim_branch_lineage(spark, sf_dir):
    """The older generation's marker for branches at depth 0, where the order of the walk plays no part."""
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: heuristics.trim_descendant_features(g, lambda x: x.branches(), 0).bad)


@_register("def_use")
def def_use(spark, sf_dir):
    """(image_id, addr, other): a user of a register and the last definer met."""
    return metrics.node_pairs(images.documents(spark, sf_dir), walks.def_use)


# ---------------------------------------------------------------- evidence


#: The extractors that SQL can follow; those that depend on the order of a walk have queries of their own.
_FEATURES = ("NoExit", "Liveness", "LoopsWithBreak", "Callsites3", "UnfilteredGrammar", "FixpointGrammar", "Clamped", "ImgEntry", "Constant")

_EVIDENCE = _ENTRY_CLOSURE + _LIVE_ROWS + _LOOPS + """,
ev AS (SELECT image_id, addr, 2 AS weight, 'NoExit' AS feature FROM live ANTI JOIN c USING (image_id, addr) UNION ALL SELECT DISTINCT image_id, addr, 1, 'Liveness' FROM lv
       UNION ALL SELECT a.image_id, a.addr, 2, 'LoopsWithBreak' FROM looped a SEMI JOIN (SELECT e.image_id, l.loop FROM ledge e JOIN looped l ON e.image_id = l.image_id AND e.src = l.addr
       LEFT JOIN looped m ON e.image_id = m.image_id AND e.dst = m.addr WHERE m.loop IS DISTINCT FROM l.loop) b ON a.image_id = b.image_id AND a.loop = b.loop
       UNION ALL SELECT image_id, addr, 2, 'Callsites3' FROM caller GROUP BY ALL HAVING count(*) > 6 UNION ALL SELECT image_id, addr, 2 AS weight, 'UnfilteredGrammar' AS feature FROM deg WHERE out_ >= 2 UNION ALL SELECT image_id, addr, 1, 'FixpointGrammar' FROM deg WHERE out_ >= 2
       UNION ALL SELECT image_id, addr, 2, 'Clamped' FROM free UNION ALL SELECT image_id, addr, 2, 'ImgEntry' FROM live WHERE addr = 1
       UNION ALL SELECT DISTINCT i.image_id, i.word, 2, 'Constant' FROM insn i SEMI JOIN live v ON i.image_id = v.image_id AND i.word = v.addr)"""
_TRUTH = """,
ent AS (SELECT image_id, 1::BIGINT AS addr FROM insn WHERE addr = 1 UNION SELECT image_id, addr + 1 FROM insn WHERE word = 10 AND addr < n)""" + _closure("truth", "SELECT image_id, addr FROM ent", True, "edge")


@_register("evidence", _sql("SELECT image_id, addr, weight, feature FROM ev", extra=_EVIDENCE))
def evidence(spark, sf_dir):
    return metrics.image_evidence(images.documents(spark, sf_dir), _FEATURES)


@_register("evidence_total", _sql("SELECT image_id, addr, sum(weight)::BIGINT AS total FROM ev GROUP BY ALL HAVING sum(weight) > 2", extra=_EVIDENCE))
def evidence_total(spark, sf_dir):
    return metrics.image_totals(images.documents(spark, sf_dir), _FEATURES, 2)


def _truth(spark, sf_dir) -> DataFrame:
    """Ground truth: what function entrances reach before anything is removed."""
    return metrics.node_sets(images.documents(spark, sf_dir), lambda g: g.close(metrics.entrances_of(g), forward=True), prepared=False)


@_register("ground_truth", _sql("SELECT image_id, addr FROM truth", "scan", extra=_TRUTH))
def ground_truth(spark, sf_dir):
    return _truth(spark, sf_dir)


@_register("distributions", _sql("""SELECT feature, bucket, count(*) FILTER (t) AS tp, count(*) FILTER (NOT t) AS fp FROM (
  SELECT p.*, (image_id, addr) IN (SELECT (image_id, addr) FROM truth) AS t FROM (SELECT image_id, addr, feature, least(sum(weight), 99)::BIGINT AS bucket FROM ev GROUP BY ALL) p) GROUP BY ALL""", extra=_EVIDENCE + _TRUTH))
def distributions(spark, sf_dir):
    return metrics.image_distributions(images.documents(spark, sf_dir), _FEATURES, Options().threshold)


# ---------------------------------------------------------------- metrics


@_register("function_entrances", _sql("SELECT image_id, addr FROM ent", "scan", extra=_TRUTH))
def function_entrances(spark, sf_dir):
    return images.function_entrances(_scan(spark, sf_dir).insn)


@_register("truth_counts", _sql("""SELECT image_id, count(*) FILTER (t AND i) AS true_positives, count(*) FILTER (t AND NOT i) AS false_negatives, count(*) FILTER (i AND NOT t) AS false_positives FROM (
  SELECT image_id, addr, bool_or(t) AS t, bool_or(i) AS i FROM (SELECT image_id, addr, true AS t, false AS i FROM truth UNION ALL SELECT image_id, addr, false, true FROM live) GROUP BY ALL) GROUP BY image_id""", extra=_TRUTH))
def truth_counts(spark, sf_dir):
    s = _live(spark, sf_dir)
    return metrics.truth_counts(s.insn, s.vertex, _truth(spark, sf_dir))


@_register("truth_closure", _sql("SELECT image_id, addr FROM c", extra=_TRUTH + _closure("c", "SELECT image_id, addr FROM truth SEMI JOIN live USING (image_id, addr)", True)))
def truth_closure(spark, sf_dir):
    """What the surviving ground truth reaches."""

    def step(g):
        from spanloom.functions import graph

        truth = g.close(metrics.entrances_of(g), forward=True)
        return graph.tag(g).trim().close(truth, forward=True)

    return metrics.node_sets(images.documents(spark, sf_dir), step, prepared=False)


@_register("false_branches", _sql("""SELECT e.image_id, e.src AS addr, e.dst AS after FROM ledge e JOIN live i ON e.image_id = i.image_id AND e.src = i.addr SEMI JOIN (SELECT image_id, addr FROM deg WHERE out_ >= 2) b ON e.image_id = b.image_id AND e.src = b.addr
ANTI JOIN truth ON e.image_id = truth.image_id AND e.src = truth.addr WHERE i.addr + i.len = e.dst""", extra=_TRUTH))
def false_branches(spark, sf_dir):
    return relations.false_branches(_live(spark, sf_dir), _truth(spark, sf_dir))


@_register("occlusion", _sql("""SELECT t.image_id, sum(coalesce(len, 0))::BIGINT AS occlusive_space, coalesce(any_value(k), 0)::BIGINT AS reduced_occlusion FROM truth t LEFT JOIN live i USING (image_id, addr)
LEFT JOIN (SELECT c.image_id, count(*) AS k FROM lconf c SEMI JOIN truth x ON c.image_id = x.image_id AND c.owner = x.addr GROUP BY c.image_id) q ON q.image_id = t.image_id GROUP BY t.image_id""", extra=_TRUTH))
def occlusion(spark, sf_dir):
    return metrics.occlusion(_live(spark, sf_dir).insn, _truth(spark, sf_dir))


@_register("occluded_entrances", _sql("SELECT image_id, addr FROM ent SEMI JOIN lconf USING (image_id, addr)", extra=_TRUTH))
def occluded_entrances(spark, sf_dir):
    s = _live(spark, sf_dir)
    return metrics.occluded_entrances(s.insn, images.function_entrances(_scan(spark, sf_dir).insn))


@_register("clean_functions", _sql("SELECT image_id, addr FROM ent ANTI JOIN d USING (image_id, addr)", extra=_TRUTH + _closure("d", "SELECT DISTINCT image_id, owner AS addr FROM lconf", False)))
def clean_functions(spark, sf_dir):
    def step(g):
        from spanloom.functions import graph

        starts = metrics.entrances_of(g)
        g = graph.tag(g).trim()
        return starts & ~g.close(g.mask(g.body_nodes(g.row)[0]), forward=False)

    return metrics.node_sets(images.documents(spark, sf_dir), step, prepared=False)


_PLAIN = Options(heuristics=("ImgEntry",), analyses=(), rounds=1, converge=False)
_ROUND = _closure("c", "SELECT image_id, addr FROM live WHERE addr = 1", True) + f", m AS ({_BODIES})" + _closure("gone", "SELECT image_id, addr FROM m", False)


@_register("pipeline_round1", _sql("SELECT image_id, addr FROM live ANTI JOIN gone USING (image_id, addr)", extra=_ROUND))
def pipeline_round1(spark, sf_dir):
    """One round of the main entry's heuristic, without analyses and convergence."""
    return metrics.survivors(images.documents(spark, sf_dir), _PLAIN)


@_register("pipeline_no_exit", _sql("SELECT image_id, addr FROM live ANTI JOIN gone USING (image_id, addr)", extra=_ENTRY_CLOSURE + _closure("gone", "SELECT image_id, addr FROM live ANTI JOIN c USING (image_id, addr)", False)))
def pipeline_no_exit(spark, sf_dir):
    """One round that drops whatever can run into what reaches no end."""
    return metrics.survivors(images.documents(spark, sf_dir), Options(heuristics=("NoExit",), analyses=(), rounds=1, converge=False))


@_register("pipeline_callsites", _sql("SELECT image_id, addr FROM live"))
def pipeline_callsites(spark, sf_dir):
    """The callsites' marker only clears marks, so a round of it keeps all."""
    return metrics.survivors(images.documents(spark, sf_dir), Options(heuristics=("Callsites3",), analyses=(), rounds=1, converge=False))


@_register("pipeline_converge", _sql("SELECT image_id, addr FROM live ANTI JOIN gone USING (image_id, addr)", extra=_FREE_CLOSURE + _SPARED + f", m AS ({_BODIES}), k AS (SELECT image_id, addr FROM m ANTI JOIN p USING (image_id, addr))" + _closure("gone", "SELECT image_id, addr FROM k", False)))
def pipeline_converge(spark, sf_dir):
    """Convergence on what is clamped: at a threshold of one point all evidence counts as known."""
    return metrics.survivors(images.documents(spark, sf_dir), Options(heuristics=("Clamped",), analyses=(), rounds=1, tp_threshold=0.0))


@_register("pipeline_loops", _sql("SELECT image_id, addr FROM live ANTI JOIN gone USING (image_id, addr)", extra=_LOOPS + """,
k AS (SELECT DISTINCT c.image_id, c.addr FROM lconf c SEMI JOIN (SELECT * FROM comp WHERE members > 20) l ON c.image_id = l.image_id AND c.owner = l.addr
SEMI JOIN (SELECT e.image_id, e.src FROM ledge e SEMI JOIN (SELECT * FROM comp WHERE members > 20) l ON e.image_id = l.image_id AND e.dst = l.addr) q ON c.image_id = q.image_id AND c.addr = q.src
ANTI JOIN (SELECT * FROM comp WHERE members > 20) o ON c.image_id = o.image_id AND c.addr = o.addr)""" + _closure("gone", "SELECT image_id, addr FROM k", False)))
def pipeline_loops(spark, sf_dir):
    """The analysis of loops alone, with its own least size."""
    return metrics.survivors(images.documents(spark, sf_dir), Options(heuristics=(), rounds=1, converge=False))


_SUMMARY = _TRUTH + _ROUND + """,
fin AS (SELECT * FROM live ANTI JOIN gone USING (image_id, addr)),
fedge AS (SELECT e.* FROM ledge e SEMI JOIN fin f ON e.image_id = f.image_id AND e.src = f.addr),
fconf AS (SELECT b.* FROM lbody b SEMI JOIN fin f ON b.image_id = f.image_id AND b.addr = f.addr SEMI JOIN fin o ON b.image_id = o.image_id AND b.owner = o.addr)""" + _closure("dirty", "SELECT DISTINCT image_id, owner AS addr FROM fconf", False, "fedge") + """,
part AS (
  SELECT image_id, 'n_entrances' AS what, count(*) AS v FROM ent GROUP BY image_id
  UNION ALL SELECT image_id, 'size', max(n) FROM insn GROUP BY image_id
  UNION ALL SELECT image_id, 'occlusive_space', sum(len) FROM truth JOIN fin USING (image_id, addr) GROUP BY image_id
  UNION ALL SELECT image_id, 'reduced_occlusion', count(*) FROM fconf SEMI JOIN truth t ON fconf.image_id = t.image_id AND fconf.owner = t.addr GROUP BY image_id
  UNION ALL SELECT image_id, 'n_clean', count(*) FROM ent ANTI JOIN dirty USING (image_id, addr) GROUP BY image_id
  UNION ALL SELECT image_id, 'n_occluded', count(*) FROM ent SEMI JOIN fconf USING (image_id, addr) GROUP BY image_id
  UNION ALL SELECT image_id, 'true_positives', count(*) FROM truth SEMI JOIN fin USING (image_id, addr) GROUP BY image_id
  UNION ALL SELECT image_id, 'false_negatives', count(*) FROM truth ANTI JOIN fin USING (image_id, addr) GROUP BY image_id
  UNION ALL SELECT image_id, 'false_positives', count(*) FROM fin ANTI JOIN truth USING (image_id, addr) GROUP BY image_id
  UNION ALL SELECT image_id, 'survivors', count(*) FROM fin GROUP BY image_id
),
summary AS (SELECT image_id, """ + ", ".join(f"coalesce(sum(v) FILTER (what = '{c.split()[0]}'), 0)::BIGINT AS {c.split()[0]}" for c in metrics.SUMMARY.split(", ")) + """ FROM part GROUP BY image_id)"""


@_register("metrics_round1", _sql("SELECT * FROM summary", extra=_SUMMARY))
def metrics_round1(spark, sf_dir):
    return metrics.run_summary(images.documents(spark, sf_dir), _PLAIN)


@_register("rollup_round1", _sql("SELECT sum(false_negatives)::BIGINT AS total_false_negatives, sum(occlusive_space) / count(*) AS mean_occlusive_space, count(*) AS images FROM summary", extra=_SUMMARY))
def rollup_round1(spark, sf_dir):
    return sinks.corpus_rollup(metrics.run_summary(images.documents(spark, sf_dir), _PLAIN))


@_register("pipeline_full")
def pipeline_full(spark, sf_dir):
    return metrics.survivors(images.documents(spark, sf_dir), Options())


@_register("metrics_summary")
def metrics_summary(spark, sf_dir):
    return metrics.run_summary(images.documents(spark, sf_dir), Options())


@_register("pipeline_compat")
def pipeline_compat(spark, sf_dir):
    return metrics.run_summary(images.conversations(spark, sf_dir), Options(compat=True))


@_register("corpus_rollup")
def corpus_rollup(spark, sf_dir):
    return sinks.corpus_rollup(metrics.run_summary(images.documents(spark, sf_dir), Options()))


# ---------------------------------------------------------------- sinks


@_register("isg_text", _sql("SELECT image_id, src || '-' || dst AS line FROM ledge UNION ALL SELECT image_id, addr::VARCHAR FROM live ANTI JOIN deg USING (image_id, addr)"))
def isg_text(spark, sf_dir):
    return sinks.graph_lines(_live(spark, sf_dir))


@_register("isg_dot", _sql("""SELECT image_id, '"' || addr || '" [shape=box, height=' || len || ', color="#660000"];' AS line FROM live UNION ALL SELECT image_id, '"' || src || '" -> "' || dst || '";' FROM ledge"""))
def isg_dot(spark, sf_dir):
    return sinks.image_dot_lines(images.documents(spark, sf_dir))


@_register("isg_dot_judged", _sql("""SELECT image_id, '"' || addr || '" [shape=box, height=' || len || ', color="' || CASE WHEN (image_id, addr) IN (SELECT (image_id, addr) FROM truth) THEN 'green' ELSE 'yellow' END || '"];' AS line FROM live
UNION ALL SELECT image_id, '"' || src || '" -> "' || dst || '";' FROM ledge""", extra=_TRUTH))
def isg_dot_judged(spark, sf_dir):
    return sinks.image_dot_lines(images.documents(spark, sf_dir), lambda g: g.close(metrics.entrances_of(g), forward=True))


# ---------------------------------------------------------------- a second instruction set

_X86 = f"""
WITH RECURSIVE src AS (SELECT doc_id AS image_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
hx AS (SELECT image_id, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::INT) AS l FROM src),
by0 AS (SELECT image_id, 32 AS n, l, unnest(l) AS b, generate_subscripts(l, 1) AS addr FROM hx),
by1 AS (SELECT *, CASE WHEN b BETWEEN 80 AND 95 OR b IN (144, 248, 249, 252, 253) THEN ['seq','1','0'] WHEN b IN (45, 5) THEN ['seq','5','0'] WHEN b = 195 THEN ['ret','1','0'] WHEN b = 233 THEN ['jmp','5','4']
  WHEN b = 235 THEN ['jmp','2','1'] WHEN b = 232 THEN ['call','5','4'] WHEN b BETWEEN 112 AND 127 THEN ['cond','2','1'] WHEN b = 221 AND l[addr + 1] BETWEEN 192 AND 199 THEN ['seq','2','0'] ELSE ['invalid','1','0'] END AS w FROM by0),
by2 AS (SELECT *, CASE WHEN addr + w[2]::INT - 1 > n THEN 'invalid' ELSE w[1] END AS kind, w[2]::INT AS total, w[3]::INT AS rel FROM by1),
insn AS MATERIALIZED (
  SELECT image_id, addr::BIGINT AS addr, CASE WHEN kind = 'invalid' THEN 1 ELSE total END::INT AS len, kind <> 'invalid' AS valid, kind,
         CASE WHEN kind IN ('cond','call','seq') THEN addr + total END::BIGINT AS fall,
         CASE WHEN kind IN ('jmp','cond','call') THEN addr + total + CASE WHEN rel = 1 THEN l[addr + 1] - CASE WHEN l[addr + 1] > 127 THEN 256 ELSE 0 END
              ELSE l[addr + 1] + 256 * l[addr + 2] + 65536 * l[addr + 3] + 16777216::BIGINT * (l[addr + 4] - CASE WHEN l[addr + 4] > 127 THEN 256 ELSE 0 END) END END::BIGINT AS jump, n::BIGINT AS n
  FROM by2
),
tgt AS (SELECT image_id, n, len, addr AS src, fall AS dst FROM insn WHERE fall IS NOT NULL UNION SELECT image_id, n, len, addr, jump FROM insn WHERE jump IS NOT NULL),
edge AS MATERIALIZED (SELECT image_id, src, dst FROM tgt)"""


@_register("x86_decode", _X86 + "\nSELECT image_id, addr, len, valid, kind, fall, jump, n FROM insn")
def x86_decode(spark, sf_dir):
    """Random bytes by the x86 subset; targets lie up to 2 ** 31 away on either side."""
    return decode(images.hashes(spark, sf_dir), "x86").select("image_id", "addr", "len", "valid", "kind", "fall", "jump", "n")


@_register("x86_inv_target_in_body", _X86 + "\nSELECT DISTINCT image_id, src AS addr FROM tgt WHERE dst > src AND dst < src + len")
def x86_inv_target_in_body(spark, sf_dir):
    return invariants.REGISTRY["Tag target in body"](scan(images.hashes(spark, sf_dir), "x86"))


@_register("x86_trim", _X86 + _MARKS + """,
dead AS (SELECT image_id, addr FROM bad UNION SELECT e.image_id, e.src FROM edge e JOIN dead d ON e.image_id = d.image_id AND e.dst = d.addr)
SELECT image_id, addr, len, kind FROM insn ANTI JOIN dead USING (image_id, addr)""")
def x86_trim(spark, sf_dir):
    return trimmed_rows(images.hashes(spark, sf_dir), ("addr", "len", "kind"), "x86")


@_register("digests", "SELECT doc_id AS image_id, md5(text) || 'text' AS digest FROM documents WHERE text IS NOT NULL")
def digests(spark, sf_dir):
    return sinks.digests(images.documents(spark, sf_dir))


@_register("metrics_format", _sql("SELECT image_id, 'size ' || max(n) || ', rows ' || count(*) AS text FROM insn GROUP BY image_id", "scan"))
def metrics_format(spark, sf_dir):
    return sinks.format_metrics(relations.stats(_scan(spark, sf_dir).insn), "size %1, rows %2", ["total_bytes", "n_rows"])


# ---------------------------------------------------------------- distribution


@_register("nearest_work", """WITH w AS (SELECT doc_id AS fname, octet_length(encode(text)) / 1024.0::DOUBLE AS size FROM documents WHERE text IS NOT NULL),
h AS (SELECT conv_id * 1000 + turn AS hostname, length(text) / 256.0::DOUBLE AS want FROM conversations WHERE text IS NOT NULL),
s AS (SELECT size, max(fname) AS fname FROM w GROUP BY size)
SELECT hostname, arg_min(size, (abs(size - want), size)) AS size, arg_min(fname, (abs(size - want), size)) AS fname FROM h, s GROUP BY hostname""")
def nearest_work(spark, sf_dir):
    """Hosts stand for turns of conversations, tasks for documents."""
    from spanloom.runtime import table

    tasks = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("fname"), (F.octet_length("text") / F.lit(1024.0)).alias("size"))
    hosts = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("hostname"), (F.char_length("text") / F.lit(256.0)).alias("want"))
    return work.nearest(hosts, tasks)


@_register("work_sizes", "SELECT doc_id AS fname, CASE WHEN m = floor(m) THEN m ELSE m + 1 END AS size, 1024 * (CASE WHEN m = floor(m) THEN m ELSE m + 1 END) AS complexity FROM (SELECT doc_id, octet_length(encode(text)) / 1048576.0::DOUBLE AS m FROM documents WHERE text IS NOT NULL)")
def work_sizes(spark, sf_dir):
    from spanloom.runtime import table

    sized = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("fname"), work.size_key(F.octet_length("text")).alias("size"))
    return sized.withColumn("complexity", work.complexity(F.col("size")))
