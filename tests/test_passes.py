"""Mate paths carried out on nodes that they run through once, several times, or over a self-edge."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import inspect, passes
from strandweave.params import Params
from strandweave.plans import assembly

from . import sequential as S
from .test_graph import contigs, graph_of, random_dna

PATHS = "start string, dest string, start_dir string, exp_dir string, path array<struct<sdir:string,ddir:string,node:string>>"


def paths_df(spark, *walks):
    return spark.createDataFrame([(w[0][0], w[-1][3], w[0][1], w[-1][2], [(a, b, v) for _, a, b, v in w]) for w in walks], PATHS)


def ways_of(walks, edges):
    """Every pass of the walks as (node, a, steps, b), the smaller of both readings."""
    out = set()
    for walk in walks:
        at = 0
        while at < len(walk):
            u, a, b, v = walk[at]
            to = at + 1
            while to < len(walk) and walk[to][0] == walk[to][3]:
                to += 1
            if u != v and to < len(walk):
                _, c, d, w = walk[to]
                own = [(e, f) for _, e, f, _ in walk[at + 1 : to]]
                here = ((S.flip(b), S.flip(a), u), own, (c, d, w))
                there = (here[2], [(S.flip(f), S.flip(e)) for e, f in reversed(own)], here[0])
                needs = [(v, *here[0]), (v, *here[2]), *((v, e, f, v) for e, f in own)]
                if all(x in edges for x in needs):
                    x, y, z = min(here, there)
                    out.add((v, x, tuple(y), z))
            at = to
    return out


def split_all(nodes, edges, ways, chosen):
    """(nodes, edges) after the split, node by node and port by port."""
    cov, used = dict(nodes), {}
    out_nodes = {n: c for n, c in nodes if n not in chosen}
    out_edges = {e for e in edges if e[0] not in chosen and e[3] not in chosen}

    def both(u, a, b, v):
        out_edges.update({(u, a, b, v), (v, S.flip(b), S.flip(a), u)})

    for v in chosen:
        mine = sorted(w[1:] for w in ways if w[0] == v)
        used = {p for a, _, b in mine for p in (a, b)}
        spare = sorted(e[1:] for e in edges if e[0] == v and e[3] != v and e[1:] not in used)
        i = 0
        for a, own, b in mine:
            for j in range(len(own) + 1):
                i += 1
                out_nodes[f"{v}_{i}"] = 1.0 if own else cov[v] / len(mine)
                if j < len(own):
                    both(f"{v}_{i}", *own[j], f"{v}_{i + 1}")
            both(f"{v}_{i - len(own)}", *a)
            both(f"{v}_{i}", *b)
        for p in spare:
            i += 1
            out_nodes[f"{v}_{i}"] = 1.0
            both(f"{v}_{i}", *p)
    return out_nodes, out_edges


@pytest.mark.parametrize("seed", range(4))
def test_against_node_by_node(spark, seed):
    rng = random.Random(seed)
    names = "abcdefgh"
    edges = {(rng.choice(names), rng.choice("fr"), rng.choice("fr"), rng.choice(names)) for _ in range(14)}
    edges |= {(n, *rng.choice(["ff", "fr", "rf"]), n) for n in "abc"}
    g = graph_of(spark, [(n, "A" * 9, 6.0) for n in names], edges)
    every = sorted(tuple(r) for r in g.edges.collect())
    walks = {}
    for _ in range(60):
        at, way, walk = rng.choice(names), rng.choice("fr"), []
        for _ in range(rng.randint(2, 7)):
            go = [e for e in every if e[0] == at and e[1] == way]
            if not go:
                break
            own = [e for e in go if e[0] == e[3]]
            walk.append(rng.choice(own if own and rng.random() < 0.6 else go))
            at, way = walk[-1][3], walk[-1][2]
        if walk:
            walks[walk[0][0], walk[-1][3]] = walk
    lost = set(rng.sample(every, 2))
    lost |= {(v, S.flip(b), S.flip(a), u) for u, a, b, v in lost}
    left = set(every) - lost
    g = type(g)(g.nodes, spark.createDataFrame(sorted(left), g.edges.schema), g.threads, g.starts)
    ways = passes.passes(g, paths_df(spark, *walks.values())).cache()
    got = [(r.node_id, tuple(r.a), tuple(tuple(s) for s in r.steps), tuple(r.b)) for r in ways.collect()]
    want = ways_of(walks.values(), left)
    assert len(got) == len(want) and set(got) == want and any(w[2] for w in want)
    degree = lambda n, d: sum(1 for u, a, *_ in left if (u, a) == (n, d))
    could = {w[0] for w in want if max(degree(w[0], "f"), degree(w[0], "r")) > 1}
    assert {r.node_id for r in passes.splitters(g, ways).collect()} == could
    chosen = []
    for n in sorted(could):
        if not any({u, v} == {n, m} for m in chosen for u, _, _, v in left):
            chosen.append(n)
    out = passes.split(g, ways, spark.createDataFrame([(n,) for n in chosen], "node_id string"))
    nodes, links = split_all([(n, 6.0) for n in names], left, want, chosen)
    assert {r.node_id: r.cov for r in out.nodes.collect()} == pytest.approx(nodes)
    assert sorted(tuple(r) for r in out.edges.select("src", "sdir", "ddir", "dst").collect()) == sorted(links)
    assert inspect.check_graph(out, 9).first().edges_missing == 0


def test_spare_ports_get_copies_of_their_own(spark):
    """A mate path p > x > s over a node with three edges on one side and two on the other."""
    nodes = [("x", "A" * 9, 6.0), *((n, "A" * 20, 2.0) for n in "pqstu")]
    edges = [("p", "f", "f", "x"), ("q", "f", "f", "x"), *(("x", "f", d, n) for d, n in zip("ffr", "stu", strict=True))]
    g = graph_of(spark, nodes, edges)
    ways = passes.passes(g, paths_df(spark, [("p", "f", "f", "x"), ("x", "f", "f", "s")])).cache()
    out = passes.split(g, ways, passes.splitters(g, ways))
    copies = {r.node_id: (r.seq, r.cov) for r in out.nodes.collect() if r.node_id.startswith("x")}
    assert copies["x_1"] == ("A" * 9, 6.0) and {copies[f"x_{i}"] for i in (2, 3, 4)} == {("A" * 9, 1.0)} and len(copies) == 4
    links = {(r.src, r.sdir, r.ddir, r.dst) for r in out.edges.collect()}
    assert {(a, d, e, b) for a, d, e, b in links if a == "x_1"} == {("x_1", "r", "r", "p"), ("x_1", "f", "f", "s")}
    assert sorted((d, e, b) for a, d, e, b in links if a in ("x_2", "x_3", "x_4")) == [("f", "f", "t"), ("f", "r", "u"), ("r", "r", "q")]
    assert all((b, S.flip(e), S.flip(d), a) in links for a, d, e, b in links) and inspect.check_graph(out, 9).first().edges_missing == 0
    assert [r.node_id for r in out.edges.where("src = 'p'").select(F.col("dst").alias("node_id")).collect()] == ["x_1"]


@pytest.mark.parametrize("times", [1, 2, 3])
def test_scaffold_writes_a_repeat_as_often_as_mates_say(spark, times):
    """Unique ends around a repeat that follows itself and also stands elsewhere: the distance tells how often it stands here."""
    k, unit = 11, random_dna(30, 5)
    left, right, other, more = (random_dna(30, 50 + i) for i in range(4))
    v = unit + unit[: k - 1]
    nodes = [("s", left + unit[: k - 1], 2.0), ("t", unit[: k - 1] + right, 2.0), ("v", v, 20.0), ("x", other + unit[: k - 1], 20.0), ("y", unit[: k - 1] + more, 20.0)]
    edges = [("s", "f", "f", "v"), ("v", "f", "f", "v"), ("v", "f", "f", "t"), ("x", "f", "f", "v"), ("v", "f", "f", "y")]
    gap = 1 - k + 30 * times
    p = Params(k=k, insert_len=gap + 40 + 39, wiggle=10, min_unique_cov=1.0, max_unique_cov=3.0, tip_len=12)
    starts = [("s", "m_1", False, 0), ("t", "m_2", True, 39), ("s", "n_1", False, 0), ("t", "n_2", True, 39), ("s", "o_1", False, 0), ("t", "o_2", True, 39)]
    out, n = assembly.scaffold(graph_of(spark, nodes, edges, [], starts), p)
    whole = left + unit * times + unit[: k - 1] + right
    want = [whole, other + unit[: k - 1] + v[k - 1 :], v + more]
    assert n > 0 and contigs(out) == sorted(min(w, S.rc(w)) for w in want)
