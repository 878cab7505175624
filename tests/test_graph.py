"""Kernels on small hand-made images and graphs, and on random ones against brute force."""

import random

import numpy as np
import pytest

from spanloom.functions import graph, heuristics, isa, walks
from spanloom.functions.graph import Graph
from spanloom.functions.heuristics import Options


def x86(*data: int) -> Graph:
    return graph.build(isa.x86_subset(bytes(data), np.array([0, len(data)])))


def drawn(edges, rows=None, image=0) -> Graph:
    """edges along control flow; rows: address to length, by default one byte for every node."""
    nodes = sorted({x for e in edges for x in e} | set(rows or ()))
    rows = {v: 1 for v in nodes} if rows is None else rows
    at = {v: i for i, v in enumerate(nodes)}
    n = len(nodes)
    ints = lambda f: np.array([f(v) for v in nodes], np.int64)
    e = sorted(set(edges))
    return Graph(
        image=np.full(n, image), addr=ints(lambda v: v), length=ints(lambda v: rows.get(v, 0)), valid=np.array([v in rows for v in nodes]), row=np.array([v in rows for v in nodes]), vertex=np.ones(n, bool),
        src=np.array([at[a] for a, _ in e], np.int64), dst=np.array([at[b] for _, b in e], np.int64), bad=np.zeros(n, bool), defs=np.zeros(n, np.int64), uses=np.zeros(n, np.int64), size=np.full(n, 1000), kind=np.full(n, 5), word=np.full(n, -1), jump=np.zeros(n, np.int64),
    )


def addrs(g: Graph, mask) -> set[int]:
    return set(g.addr[mask].tolist())


def reach(edges, seeds, forward):
    found, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for a, b in edges:
            y = b if forward and a == x else a if not forward and b == x else None
            if y is not None and y not in found:
                found.add(y)
                todo.append(y)
    return found


def loop_edges(start, finish):
    """A chain of halving steps from finish to start and back again."""
    nodes, step = [finish], finish
    while step > start:
        step = max(start, step // 2)
        nodes.append(step)
    return [(a, b) for a, b in zip(nodes, nodes[1:])] + [(start, finish)]


# ---------------------------------------------------------------- byte strings


def test_every_offset_is_decoded():
    assert x86(0x2D, 0xDD, 0xC3, 0x54, 0x55).length[:5].tolist() == [5, 2, 1, 1, 1]


def test_trim_leaves_the_return():
    g = graph.tag(x86(0x2D, 0xDD, 0xC3, 0x54, 0x55)).trim()
    assert addrs(g, g.vertex) == {3}


def test_invalid_jump_is_trimmed():
    g = graph.tag(x86(0x55, 0x54, 0xE9, 0xFC, 0xFF, 0xFF, 0xFF)).trim()
    assert not g.vertex.any()


@pytest.mark.parametrize(("data", "name"), [((0x0F, 0xFF), "Tag non insn"), ((0x77, 0xFF), "Tag target in body"), ((0x77, 0x77), "Tag target not in mem")])
def test_each_invariant_removes_the_first_address(data, name):
    g = graph.tag(x86(*data), (name,)).trim()
    assert 1 not in addrs(g, g.vertex)


def test_successors():
    fall = x86(0x54, 0x55)
    assert (1, 2) in zip(fall.addr[fall.src].tolist(), fall.addr[fall.dst].tolist())
    both = x86(0x77, 0x77)
    assert (both.addr[both.src] == 1).sum() == 2
    beyond = x86(0x2D, 0xDD, 0xC3, 0x54, 0x55)
    assert (beyond.addr[beyond.dst] > 5).any()


def test_map_and_graph_agree_after_trim():
    g = graph.tag(x86(0x55, 0x54, 0xC3, 0x2D, 0x77, 0x00, 0xC3)).trim()
    assert (g.vertex == g.row).all()


def test_unknown_names_are_passed_over():
    g = x86(0x0F, 0xFF)
    assert not graph.tag(g, ("no such",)).bad.any()


# ---------------------------------------------------------------- shapes


def test_direction_on_a_chain():
    g = drawn([(1, 2), (2, 3)])
    assert addrs(g, g.close(g.mask(np.array([1])), True)) == {2, 3}
    assert addrs(g, g.close(g.mask(np.array([1])), False)) == {1, 2}
    assert addrs(g, g.entries()) == {3} and addrs(g, g.fronds()) == {1}


def test_loop_is_one_component():
    g = drawn(loop_edges(1, 21))
    label, inside = g.loops(1)
    assert inside.all() and len(set(label.tolist())) == 1
    chain = drawn([(0, 1)])
    assert not chain.loops(1)[1].any()


@pytest.mark.parametrize("k", [6, 2])
def test_tail_conflicts(k):
    tail = 50
    edges = [(tail - i, tail) for i in range(1, k + 1)]
    g = drawn(edges, {tail: 1, **{tail - i: i for i in range(1, k + 1)}})
    owner, _ = g.body_nodes(g.row)
    # An instruction of length i at tail - i ends right before the tail; the inner ones overlap each other.
    assert len(set(owner.tolist())) == k - 1
    longer = drawn(edges, {tail: 1, **{tail - i: i + 1 for i in range(1, k + 1)}})
    assert len(set(longer.body_nodes(longer.row)[0].tolist())) == k


def test_loop_contradiction_spares_the_loop():
    loop = loop_edges(1, 21)
    nodes = {x for e in loop for x in e}
    # 6 lies in the body of the loop's 5 and runs into the loop.
    g = drawn([*loop, (6, 10)], {**{v: 1 for v in nodes}, 5: 3, 6: 1})
    marked = heuristics.loop_contradictions(g, 1)
    assert addrs(g, marked.bad) == {6}
    after = marked.trim()
    assert addrs(after, after.vertex) == nodes and (after.vertex == after.row).all()


def test_diamond_has_one_branch():
    # 50 branches to 52 (its fall-through, as it has no row) and 54; both meet at 56.
    g = drawn([(50, 52), (50, 54), (52, 56), (54, 56)], {52: 2, 54: 2, 56: 2, 50: 2})
    assert addrs(g, walks.identify_branches(g)) <= {50}
    assert addrs(g, g.branches()) == {50} and addrs(g, g.mask(g.dst[np.bincount(g.dst, minlength=g.n)[g.dst] > 1])) == {56}


def test_topological_visits_once():
    g = drawn([(0, 1), (1, 2), (0, 2)])
    order = walks.topological(g)
    assert [int(g.addr[i]) for i in order] == [0, 1, 2]


def test_walk_starts_at_the_root():
    g = drawn([(41, 40), (42, 40)])
    events = [int(g.addr[n]) for entered, n in walks.Walker(g).walk([0]) if entered]
    assert events == [40, 41, 42]


def test_live_in():
    g = drawn([(1, 2), (2, 3)])
    g.defs[:], g.uses[:] = [1, 0, 0], [0, 2, 1]
    assert g.live_in().tolist() == [2, 3, 1]


def test_threshold_is_truncated_and_rounds_checked():
    assert Options().threshold == 99
    with pytest.raises(ValueError):
        Options(rounds=0)


# ---------------------------------------------------------------- against brute force


def random_graph(rng):
    n = rng.randrange(2, 14)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))]
    return edges, drawn(edges, {v: rng.randrange(1, 5) for v in range(n)})


@pytest.mark.parametrize("seed", range(40))
def test_random_graphs(seed):
    rng = random.Random(seed)
    edges, g = random_graph(rng)
    nodes = set(g.addr.tolist())
    seeds = {v for v in nodes if rng.random() < 0.3}
    mask = np.isin(g.addr, list(seeds))
    for forward in (True, False):
        assert addrs(g, g.close(mask, forward)) == reach(edges, seeds, forward)
    label, inside = g.loops(1)
    back = {v: reach(edges, [v], True) for v in nodes}
    mutual = {v: frozenset(w for w in nodes if w in back[v] and v in back[w]) for v in nodes}
    assert addrs(g, inside) == {v for v in nodes if len(mutual[v]) > 1}
    assert all(int(g.addr[label[i]]) == min(mutual[int(g.addr[i])]) for i in np.flatnonzero(inside))
    body = {v: {w for w in nodes if v < w < v + int(g.length[g.addr == v][0])} for v in nodes}
    assert addrs(g, g.conflicts(g.row)) == {v for v in nodes if body[v]} | {w for v in nodes for w in body[v]}
    assert addrs(g, heuristics.loops_with_break(g)) == {v for v in nodes if len(mutual[v]) > 1 and any(a in mutual[v] and b not in mutual[v] for a, b in edges)}
    gone = reach(edges, seeds, False)
    after = g.mark(mask).trim()
    assert addrs(after, after.vertex) == nodes - gone
    assert set(zip(after.addr[after.src].tolist(), after.addr[after.dst].tolist())) == {e for e in edges if not gone & set(e)}


@pytest.mark.parametrize("seed", range(60))
def test_old_generation(seed):
    """Definition-use pairs and the markers built on them, against plain recursion and sets."""
    rng = random.Random(5000 + seed)
    edges, g = random_graph(rng)
    g = g.with_(defs=np.array([rng.choice([0, 1, 2, 4, 5]) for _ in range(g.n)]), uses=np.array([rng.choice([0, 1, 2, 4, 6]) for _ in range(g.n)]), kind=np.array([rng.choice([3, 5]) for _ in range(g.n)]))
    nodes = g.addr.tolist()
    at = {v: i for i, v in enumerate(nodes)}
    pred = {v: sorted({a for a, b in edges if b == v}) for v in nodes}
    succ = {v: {b for a, b in edges if a == v} for v in nodes}
    has = lambda masks, v: {r for r in range(3) if int(masks[at[v]]) >> r & 1}
    pairs = {}

    def climb(v, seen, user):
        seen.add(v)
        user.update({r: v for r in has(g.uses, v)})
        for w in pred[v]:
            if w not in seen:
                climb(w, seen, user)
        for r in has(g.uses, v):
            user.pop(r, None)
        for r in sorted(has(g.defs, v)):
            if r in user and user[r] != v:
                pairs[user[r]] = v
        for r in has(g.defs, v):
            user.pop(r, None)

    for v in nodes:
        if not succ[v] and pred[v]:
            climb(v, set(), {})
    assert {nodes[a]: nodes[b] for a, b in walks.def_use(g).items()} == pairs
    assert addrs(g, walks.definers(g)) == set(pairs.values())

    length = dict(zip(nodes, g.length.tolist()))
    body = {v: {w for w in nodes if v < w < v + length[v]} for v in nodes}
    spared = reach(edges, [b for a, b in edges if b != a + length[a]], True)
    seeds = {v for v in nodes if rng.random() < 0.4}
    for always in (False, True):
        # One walk after the other, each past what was visited before.
        visited, marked = set(spared), set()

        def descend(v):
            visited.add(v)
            marked.update(body[v])
            for w in sorted(succ[v]):
                if w not in visited:
                    descend(w)

        for v in sorted(seeds):
            if always or v not in visited:
                descend(v)
        assert addrs(g, heuristics.mark_lineage_bodies(g, np.isin(g.addr, list(seeds)), always).bad) == marked - visited

    kept = heuristics.discard_edges(g)
    assert set(zip(kept.addr[kept.src].tolist(), kept.addr[kept.dst].tolist())) == {(a, b) for a, b in edges if g.kind[at[a]] != isa.CALL or b == a + length[a]}


def test_old_points():
    """A branch counts five points, and 50 must be exceeded along a walk."""
    edges = [e for v in range(0, 24, 2) for e in ((v, v + 1), (v, v + 2), (v + 1, v + 2))]
    g = drawn(edges)
    total = walks.running_evidence(g, heuristics.evidence_total(g, ("FixpointGrammar", "LayerViolations"), heuristics.OLD_EXTRACTORS, heuristics.OLD_WEIGHTS))
    assert addrs(g, total > heuristics.OLD_THRESHOLD) == {20, 22}


@pytest.mark.parametrize("seed", range(25))
def test_random_walks(seed):
    """Order-dependent operators against plain recursion."""
    edges, g = random_graph(random.Random(1000 + seed))
    nodes = sorted(g.addr.tolist())
    pred = {v: sorted({a for a, b in edges if b == v}) for v in nodes}
    succ = {v: sorted({b for a, b in edges if a == v}) for v in nodes}
    length = dict(zip(g.addr.tolist(), g.length.tolist()))
    body = {v: [w for w in nodes if v < w < v + length[v]] for v in nodes}
    clash = {v for v in nodes if body[v]} | {w for v in nodes for w in body[v]}
    entries = [v for v in nodes if not succ[v] and pred[v]]

    def pre_order(v, near, seen):
        seen.add(v)
        out = [v]
        for w in near[v]:
            if w not in seen:
                out += pre_order(w, near, seen)
        return out

    clamp = set()
    for e in entries:
        for v in pre_order(e, pred, set()):
            if v != e and v in clash:
                break
            clamp |= {v} - {e}
    assert addrs(g, walks.restricted_clamp(g)) == clamp

    free = {v for v in nodes if v not in clash}
    wide = set(free)
    for f in free:
        seen, stack = {f}, [f]
        while stack:
            v = stack.pop()
            if body[v]:
                break
            wide.add(v)
            for w in pred[v]:
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
    assert addrs(g, walks.extended_clamp(g)) == wide

    weight = np.array([2 if len(succ[v]) > 1 else 0 for v in nodes])
    want, seen = dict(zip(nodes, weight.tolist())), set()
    for f in [v for v in nodes if succ[v] and not pred[v]]:
        total = 0
        for v in pre_order(f, succ, seen) if f not in seen else []:
            if want[v] and weight[nodes.index(v)]:
                total += int(weight[nodes.index(v)])
                want[v] = total
    assert dict(zip(nodes, walks.running_evidence(g, weight).tolist())) == want


@pytest.mark.parametrize("seed", range(10))
def test_t8_against_plain_rules(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 40))) for _ in range(5)]
    d = isa.t8(b"".join(texts), np.cumsum([0, *map(len, texts)]))
    at = 0
    for data in texts:
        for addr, b in enumerate(data, 1):
            length, k = 1 + b % 4, b // 4 % 8
            kind = ["ret", "jmp", "cond", "call", "invalid", "seq", "seq", "seq"][k]
            if addr + length - 1 > len(data):
                kind = "invalid"
            if kind == "invalid":
                length = 1
            assert (isa.KINDS[d.kind[at]], d.length[at], d.addr[at]) == (kind, length, addr)
            assert d.has_fall[at] == (kind in ("seq", "cond", "call")) and d.has_jump[at] == (kind in ("jmp", "cond", "call"))
            if d.has_jump[at]:
                assert d.jump[at] == addr + length + b * 37 % 41 - 20
            at += 1


@pytest.mark.parametrize("seed", range(10))
def test_generic_fixpoint_and_linear_sweep(seed):
    edges, g = random_graph(random.Random(2000 + seed))
    nodes = g.addr.tolist()
    # The largest address that reaches each node, itself included.
    got = graph.fixpoint(g, g.addr.copy(), lambda values, _: values)
    assert dict(zip(nodes, got.tolist())) == {v: max(reach(edges, [v], False)) for v in nodes}
    length = dict(zip(nodes, g.length.tolist()))
    want, at = set(), 1
    while at in length:
        want.add(at)
        at += length[at]
    assert addrs(g, walks.linear_sweep(g)) == want
