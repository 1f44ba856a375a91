"""Fixpoints driven by what changed, list ranking, path counting and independent sets, against plain versions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.operators import build, compact, correct, live, mates, ranking, threads
from strandweave.operators.graph import Graph
from strandweave.params import Params
from strandweave.plans import assembly
from strandweave.storage import Workspace

from . import sequential as S
from .test_graph import contigs, graph_of, random_dna, reads_df


def noisy_reads(seed, n=60, size=700, length=70, errors=0.012):
    rng = random.Random(seed)
    genome = random_dna(size, seed)
    genome = genome[: size // 2] + genome[100:160] + genome[size // 2 :]
    out = []
    for _ in range(n * 3):
        at = rng.randrange(len(genome) - length)
        out.append("".join(rng.choice("ACGT") if rng.random() < errors else c for c in genome[at : at + length]))
    return out


def full_tips(graph, p):
    total = 0
    while (n := (victims := Workspace(graph.nodes.sparkSession, "v").put(correct.tip_victims(graph, p), "v")).count()):
        graph, total = compact.compact(graph.without(victims), p.k), total + n
    return graph, total


def full_bubbles(graph, p):
    total = 0
    while True:
        victims, kept = correct.pop_bubbles(graph, p)
        n = victims.count()
        if n == 0:
            return graph, total
        total += n
        work = Workspace(graph.nodes.sparkSession, "full")
        nodes = graph.nodes.join(kept.select("node_id"), "node_id", "left_anti").union(kept)
        cut = Graph(nodes, graph.edges, graph.threads, graph.starts).without(victims).saved(work, "cut")
        graph, _ = full_tips(compact.compact(cut, p.k), p)


def spelled(graph):
    return sorted((min(r.seq, S.rc(r.seq)), round(r.cov, 6)) for r in graph.nodes.collect())


def shape(graph):
    """Edges, threads and starts by sequences instead of names."""
    seq = {r.node_id: (r.seq if r.seq <= S.rc(r.seq) else S.rc(r.seq), r.seq <= S.rc(r.seq)) for r in graph.nodes.collect()}
    turn = lambda d, node: d if seq[node][1] else S.flip(d)
    edges = sorted((seq[r.src][0], turn(r.sdir, r.src), turn(r.ddir, r.dst), seq[r.dst][0]) for r in graph.edges.collect())
    marks = sorted((seq[r.node_id][0], turn(r.sdir, r.node_id), seq[r.dst][0], r.read) for r in graph.threads.collect())
    starts = sorted((seq[r.node_id][0], r.read, r.rc == seq[r.node_id][1], r.off if seq[r.node_id][1] else len(seq[r.node_id][0]) - 1 - r.off) for r in graph.starts.collect())
    return edges, marks, starts


@pytest.mark.parametrize("share", [0.1, 1e9, 0.0])
def test_changed_parts_give_the_full_result(spark, monkeypatch, share):
    """The same graph, whether tables are never, sometimes or always written anew."""
    monkeypatch.setattr(live, "SHARE", share)
    p = Params(k=15, bubble_rate=0.2, low_cov=2.0)
    graph = compact.compact(build.build(reads_df(spark, noisy_reads(4)), p), p.k)
    tips, n = full_tips(graph, p)
    bubbles, m = full_bubbles(tips, p)
    mine, a = assembly.remove_tips(graph, p)
    both, b = assembly.pop_bubbles(mine, p)
    assert n > 20 and m > 2 and (a, b) == (n, m)
    assert spelled(mine) == spelled(tips) and shape(mine) == shape(tips)
    assert spelled(both) == spelled(bubbles) and shape(both) == shape(bubbles)
    assert not any("~" in r.node_id for r in both.nodes.collect())


def test_a_change_stores_what_it_changed(spark):
    """One tip on a long graph: a handful of rows, however many nodes stand elsewhere."""
    p = Params(k=15)
    parts = [random_dna(200, 100 + i) for i in range(40)]
    tip = parts[0][50:90] + "ACGTTG"
    graph = compact.compact(build.build(reads_df(spark, [*parts, tip]), p), p.k)
    now = live.Live.of(graph, "t")
    assert assembly.settle_tips(now, p) == 1 and compact.settle(now, p.k) == 0
    stored = now.rows_stored()
    assert [why for why, _, _ in stored] == ["tips", "chains"] and sum(rows for *_, rows in stored) < 20
    assert contigs(now.finished()) == sorted(min(x, S.rc(x)) for x in parts)


def test_rings_within_a_task():
    """A ring's pointers know its smallest node, also where jumps of 2, 4, 8 ... lead back to where they began."""
    rows = []
    for n in range(2, 20):
        ids = [f"{n:02}-{i:02}" for i in random.Random(n).sample(range(n), n)]
        rows += [(v, "f", ids[i - 1], "f", 1, False, v) for i, v in enumerate(ids)]
    names = [f.split(" ")[0] for f in ranking.POINTERS.split(", ")]
    out = ranking._jumped(pa.table(dict(zip(names, map(pa.array, zip(*rows, strict=True)), strict=True)))).to_pylist()
    assert len(out) == len(rows) and all(not r["done"] and r["low"] == r["node_id"][:3] + "00" for r in out)


def test_only_rings_are_ranked_again(spark, monkeypatch):
    """Beside a long chain, a ring of four is cut and ranked by its own links."""
    one = [(f"c{i:03}", f"c{i + 1:03}") for i in range(300)] + [("ra", "rb"), ("rb", "rc"), ("rc", "rd"), ("rd", "ra")]
    links = [(u, "f", "f", v) for u, v in one] + [(v, "r", "r", u) for u, v in one]
    seen, rank = [], ranking.rank
    monkeypatch.setattr(ranking, "rank", lambda p, n, *rest: seen.append(n) or rank(p, n, *rest))
    where, inner = compact.chains(spark.createDataFrame(links, "src string, sdir string, ddir string, dst string"), len(links), 5, Workspace(spark, "rings"), "x")
    assert seen == [608, 6] and inner.count() == 606
    assert sorted((r["chain"], r["count"]) for r in where.groupBy("chain").count().collect()) == [("c000", 301), ("ra", 4)]
    assert sorted(r["rank"] for r in where.where("chain = 'ra'").collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("few", [0, 50, 10**6])
def test_ranking(spark, monkeypatch, few):
    """Chains and rings of many lengths, contracted in small parts, doubled on joins, or finished in one task."""
    monkeypatch.setattr(ranking, "FEW", few)
    monkeypatch.setattr(ranking, "HELD", 40)
    rng, links, want = random.Random(few), [], {}
    for c in range(30):
        size, ring = rng.randint(2, 60), c % 5 == 0
        line = [(f"c{c:02d}n{rng.randrange(10**6):06d}", rng.choice("fr")) for _ in range(size)]
        for (u, a), (v, b) in [*zip(line, line[1:], strict=False), *([(line[-1], line[0])] if ring and size > 2 else [])]:
            links += [(u, a, b, v), (v, S.flip(b), S.flip(a), u)]
        if not (ring and size > 2):
            for way in (line, [(v, S.flip(d)) for v, d in reversed(line)]):
                want |= {(v, d): (*way[0], i) for i, (v, d) in enumerate(way)}
        else:
            want["ring", min(v for v, _ in line)] = True
    df = spark.createDataFrame(links, "src string, sdir string, ddir string, dst string").repartition(7)
    ptr, lows = ranking.rank(ranking.pointers(df), len(links), 5, Workspace(spark, "r"), "p")
    rows = ptr.collect()
    assert len(rows) == len({(r.node_id, r.dir) for r in rows}) == 2 * len({u for u, *_ in links})
    assert {(r.node_id, r.dir): (r.to_id, r.to_dir, r["rank"]) for r in rows if r.done} == {k: v for k, v in want.items() if v is not True}
    assert {r.low for r in lows.collect()} == {k[1] for k, v in want.items() if v is True}


def test_few_pointers_are_left_after_contraction(spark):
    """Neighbouring K-mers meet: what doubling works on is a fraction of all pointers."""
    p = Params(k=21)
    links = compact.compressible_links(build.build(reads_df(spark, [random_dna(6000, 7)]), p).edges)
    work = Workspace(spark, "c")
    pointers = ranking.pointers(links).repartition(64, ranking._meeting(ranking.pointers(links), p.k))
    first = work.put(pointers.mapInArrow(ranking._contract(100), ranking.POINTERS), "first")
    ends = first.where("not done").select("to_id", "to_dir").distinct().count()
    assert ends * 4 < first.count()


def test_paths_are_counted_not_listed(spark):
    """Ten bubbles in a row: 2**10 paths, and never more than two rows a hop."""
    nodes, edges = [("s", "A" * 30, 2.0), ("z", "C" * 30, 2.0)], []
    before = "s"
    for i in range(10):
        join = f"m{i}" if i < 9 else "z"
        for side in "ab":
            nodes.append((f"{side}{i}", "G" * 12, 9.0))
            edges += [(before, "f", "f", f"{side}{i}"), (f"{side}{i}", "f", "f", join)]
        if join != "z":
            nodes.append((join, "T" * 12, 9.0))
        before = join
    g = graph_of(spark, nodes, edges)
    p = Params(k=11, insert_len=300, wiggle=30, min_unique_cov=1.0, max_unique_cov=3.0, max_frontier=25)
    bundled = spark.createDataFrame([("s", "f", "f", "z", 3, 20)], "src string, sdir string, ddir string, dst string, weight long, dist long")
    found, metrics = mates.search_paths(g, bundled, p)
    assert [sum(m.values()) for m in metrics] == [2, 1] * 10
    (row,) = found.collect()
    assert row.paths == 2 and len(row.path) == 20 and {s.node[0] for s in row.path} == {"a", "m", "z"}
    assert mates.sure_paths(found).count() == 0
    one = graph_of(spark, nodes, [e for e in edges if "b" not in e[0] + e[3]])
    assert [r.paths for r in mates.search_paths(one, bundled, p)[0].collect()] == [1]
    assert mates.sure_paths(mates.search_paths(one, bundled, p)[0]).count() == 1


def test_a_line_of_splitters_takes_few_rounds(spark):
    n = 1000
    names = [f"n{i:04d}" for i in range(n)]
    g = graph_of(spark, [(x, "A" * 9, 1.0) for x in names], [(a, "f", "f", b) for a, b in zip(names, names[1:], strict=False)])
    left, rounds = {x: i for i, x in enumerate(names)}, 0
    while left:
        df = spark.createDataFrame([(x,) for x in left], "node_id string")
        chosen = {r.node_id for r in threads.independent(g, df, seed=rounds).collect()}
        assert chosen and not any(names[left[x] + 1] in chosen for x in chosen if left[x] + 1 < n)
        left = {x: i for x, i in left.items() if x not in chosen}
        rounds += 1
    assert rounds <= 12
    assert threads.independent(g, spark.createDataFrame([(x,) for x in names], "node_id string")).count() == 1  # by ids: one a round


def test_versions_of_names(spark):
    df = spark.createDataFrame([("ACGT",), ("ACGT~1",), ("a_2~19",)], "n string")
    rows = df.select(live.next_version(F.col("n")).alias("next"), live.plain_name(F.col("n")).alias("plain")).collect()
    assert [tuple(r) for r in rows] == [("ACGT~1", "ACGT"), ("ACGT~2", "ACGT"), ("a_2~20", "a_2")]


def walked(nodes, edges, start, dest, start_dir, exp_dir, exp_dist, p):
    """Every path the search may find, by walking them one by one."""
    length, out = {n: len(s) for n, s, _ in nodes}, []
    both = set(edges) | {(v, S.flip(b), S.flip(a), u) for u, a, b, v in edges}
    line = [(start, start_dir, 1 - p.k, [])]
    for h in range(p.max_frontier):
        after = []
        for cur, way, dist, path in line:
            for u, a, b, v in sorted(both):
                if (u, a) != (cur, way) or (h and v == start):
                    continue
                step = [*path, (a, b, v)]
                late = dist > exp_dist + 2 * p.wiggle
                if v == dest:
                    if not late and dist >= exp_dist - p.wiggle and b == exp_dir:
                        out.append(step)
                elif not late:
                    after.append((v, b, dist + length[v] - (p.k - 1), step))
        if len(out) > 1:
            break
        line = after
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_against_walking(spark, seed):
    rng = random.Random(seed)
    names = "stabcdef"
    nodes = [(n, "A" * rng.randint(11, 20), 2.0) for n in names]
    edges = {(u, rng.choice("fr"), rng.choice("fr"), v) for u, v in ((rng.choice(names), rng.choice(names)) for _ in range(13)) if u != v}
    g = graph_of(spark, nodes, sorted(edges))
    p = Params(k=11, insert_len=300, wiggle=8, min_unique_cov=1.0, max_unique_cov=3.0, max_frontier=5)
    asked = [("s", a, b, "t", 1, 6) for a in "fr" for b in "fr"]
    for row in asked:  # one bundle at a time: several of a pair are ambiguous together
        bundled = spark.createDataFrame([row], "src string, sdir string, ddir string, dst string, weight long, dist long")
        found, _ = mates.search_paths(g, bundled, p)
        want = walked(nodes, sorted(edges), "s", "t", row[1], row[2], row[5], p)
        got = found.collect()
        assert min(sum(r.paths for r in got), 2) == min(len(want), 2)
        assert {tuple((x.sdir, x.ddir, x.node) for x in r.path) for r in got} <= {tuple(w) for w in want}
