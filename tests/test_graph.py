import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.functions import sequence as Q
from strandweave.operators import build, compact, correct, inspect, mates, passes, stats, threads
from strandweave.operators.graph import EDGES, NODES, STARTS, THREADS, Graph
from strandweave.params import Params
from strandweave.plans import assembly, counters
from strandweave.sources import reads as sources
from strandweave.sources import sinks

from . import sequential as S


def reads_df(spark, seqs):
    return spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(seqs)], "read string, seq string")


def random_dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def tiled(genome, length):
    return [genome[i : i + length] for i in range(len(genome) - length + 1)]


def graph_of(spark, nodes=(), edges=(), threads_=(), starts=()):
    both = set(edges) | {(v, S.flip(b), S.flip(a), u) for u, a, b, v in edges}
    return Graph(spark.createDataFrame(list(nodes), NODES), spark.createDataFrame(sorted(both), EDGES), spark.createDataFrame(list(threads_), THREADS), spark.createDataFrame(list(starts), STARTS))


def contigs(graph):
    return sorted(min(r.seq, S.rc(r.seq)) for r in graph.nodes.select("seq").collect())


def test_params():
    p = Params(k=25)
    assert (p.tip_len, p.bubble_len, p.low_cov_len, p.min_unique_len) == (75, 125, 50, 25)
    for bad in (dict(k=4), dict(k=1), dict(k=5, insert_len=100)):
        with pytest.raises(ValueError):
            Params(**bad)


def test_sequence_functions(spark):
    seqs = ["", "A", "AC", "ACGT", "TTT", "GATTACA", "CCGGA"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    c = F.col("s")
    for r in df.select("s", Q.rc(c).alias("rc"), Q.canonical(c).alias("c"), Q.strand(c).alias("d"), Q.unpack(Q.pack(c)).alias("back"), Q.pack(c).alias("p")).collect():
        assert (r.rc, r.c, r.back) == (S.rc(r.s), min(r.s, S.rc(r.s)), r.s)
        assert r.d == ("f" if r.s < S.rc(r.s) else "r")
    assert [r.p for r in df.select(Q.pack(c).alias("p")).collect()][1:4] == ["A", "C", "CO"]
    r = spark.createDataFrame([("x_1", "x")], "a string, b string").select(Q.mate_basename(F.col("a")).alias("a"), Q.mate_basename(F.col("b")).alias("b")).first()
    assert (r.a, r.b) == ("x", "")
    joined = spark.createDataFrame([("AACG", "ACGT")], "a string, b string").select(Q.overlap_concat(F.col("a"), F.col("b"), 4).alias("x"))
    assert joined.first().x == "AACGT"
    with pytest.raises(Exception, match="overlap"):
        spark.createDataFrame([("AACG", "TCGT")], "a string, b string").select(Q.overlap_concat(F.col("a"), F.col("b"), 4).alias("x")).collect()


def test_cleaning(spark):
    p = Params(k=5, trim5=1, trim3=2)
    df = reads_df(spark, ["xACGTACGTyy", "NNNACGTACGNNN", "ACG", None, "AACGxTACGTTT"])
    got = {r.read: (r.seq, r.fate) for r in build.judged_reads(df, p).collect()}
    assert got == {"r0": ("ACGTACGT", "good"), "r1": ("ACGTACG", "good"), "r2": ("", "short"), "r3": ("", "short"), "r4": ("ACGXTACGT", "skipped")}
    c = build.cleaning_counters(df, p).first()
    assert (c.reads_good, c.reads_short, c.reads_skipped, c.reads_goodbp) == (2, 2, 1, 15)
    assert build.cleaning_counters(df.limit(0), p).first().reads_goodbp == 0


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ACGT", max_size=30), max_size=8))
def test_build_and_compaction_match_sequential(spark, seqs):
    k = 5
    g = build.build(reads_df(spark, seqs), Params(k=k))
    cov, edges = S.debruijn(seqs, k)
    assert {r.node_id: r.cov for r in g.nodes.collect()} == cov
    assert {tuple(r) for r in g.edges.collect()} == edges
    c = compact.compact(g, k)
    got = sorted((min(r.seq, S.rc(r.seq)), round(r.cov, 6)) for r in c.nodes.collect())
    want = S.unitigs(cov, edges, k)
    # rings may be spelled from either strand of their smallest node
    assert Counter((len(s), v) for s, v in got) == Counter((len(s), v) for s, v in want)
    check = inspect.check_graph(c, k).first()
    assert check.edges_bad == check.edges_missing == check.edges_repeated == check.threads_bad == 0
    assert {(v, S.flip(b), S.flip(a), u) for u, a, b, v in map(tuple, c.edges.collect())} == {tuple(r) for r in c.edges.collect()}


def test_chunk_tags(spark):
    k, rows = 3, {}
    seqs = ["ACGTACGTACGAAAA", "AAAAAA", "ACGTT"]
    for i, s in enumerate(seqs):
        seen, chunk = set(), 0
        for j in range(len(s) - k):
            u, v = s[j : j + k], s[j + 1 : j + 1 + k]
            hit = u in seen or v in seen or u == v
            seen.add(u)
            chunk += hit
            a = f"r{i}c{chunk}" if chunk else f"r{i}"
            chunk += hit
            rows[f"r{i}", j] = (a, f"r{i}c{chunk}" if chunk else f"r{i}")
    got = {(r.read, r.pos): (r.utag, r.vtag) for r in build.chunk_tags(reads_df(spark, seqs), k).collect()}
    assert got == rows


def test_fixture_facts(spark):
    a, r = random_dna(70, 1), random_dna(70, 2)
    genome = a + r + random_dna(70, 3) + r + random_dna(70, 4) + r + random_dna(70, 5)
    reads = sources.simulated(spark.createDataFrame([("g", genome)], "name string, seq string"), 36, 100)
    assert reads.count() == 782
    g = build.build(reads, Params(k=25))
    cov, edges = S.debruijn([r.seq for r in reads.collect()], 25)
    assert g.nodes.count() == len(cov) and g.edges.count() == len(edges)
    assert g.nodes.agg(F.sum("cov")).first()[0] == 9384
    c = compact.compact(g, 25)
    want = S.unitigs(cov, edges, 25)
    assert contigs(c) == sorted(s for s, _ in want) and len(want) >= 5
    assert inspect.check_starts(c, reads).first().starts_bad == 0


def test_ring_and_hairpin(spark):
    ring = "ACGGTCA"
    g = build.build(reads_df(spark, [ring * 3]), Params(k=5))
    c = compact.compact(g, 5)
    assert c.nodes.count() == 1 and len(contigs(c)[0]) == len(ring) + 4
    assert {(r.sdir, r.ddir) for r in c.edges.collect()} == {("f", "f"), ("r", "r")}
    stem = random_dna(40, 9)
    h = compact.compact(build.build(reads_df(spark, [stem + S.rc(stem)]), Params(k=5)), 5)
    assert inspect.check_graph(h, 5).first().edges_bad == 0


def test_tips(spark):
    p = Params(k=3, tip_len=6)
    # a long path with a short and a longer branch at its end: only the longest stays
    nodes = [("m", "A" * 20, 5.0), ("t1", "A" * 4, 1.0), ("t2", "A" * 6, 1.0), ("i", "A" * 4, 1.0), ("o", "A" * 5, 1.0), ("l", "A" * 30, 1.0)]
    g = graph_of(spark, nodes, [("m", "f", "f", "t1"), ("m", "f", "f", "t2"), ("l", "f", "f", "m"), ("o", "f", "r", "o")])
    assert {r.node_id for r in correct.tip_victims(g, p).collect()} == {"t1", "i", "o"}
    g = graph_of(spark, nodes, [("m", "f", "f", "t1"), ("m", "f", "f", "l"), ("m", "f", "r", "t2")])
    assert {"t1", "t2"} <= {r.node_id for r in correct.tip_victims(g, p).collect()}
    done, _ = correct.remove_tips(g, p)
    assert {r.dst for r in done.edges.collect()} == {"m", "l"}


def test_bubbles(spark):
    left, right, mid = random_dna(40, 11), random_dna(40, 12), random_dna(30, 13)
    other = mid[:15] + ("A" if mid[15] != "A" else "C") + mid[16:]
    p = Params(k=11, bubble_rate=0.1)
    g = build.build(reads_df(spark, [left + mid + right] * 3 + [left + other + right]), p)
    g = compact.compact(g, 11)
    total = sum(r.cov * (len(r.seq) - 10) for r in g.nodes.collect())
    done, n = assembly.pop_bubbles(g, p)
    assert n == 1 and contigs(done) == [min(left + mid + right, S.rc(left + mid + right))]
    assert abs(sum(r.cov * (len(r.seq) - 10) for r in done.nodes.collect()) - total) < 1e-6
    strict = Params(k=11, bubble_rate=0.01)
    assert assembly.pop_bubbles(g, strict)[1] == 0


def test_greedy_pops(spark):
    from strandweave.storage import Workspace

    rows = [("a", "b", 9.0, 8.0), ("b", "c", 8.0, 7.0), ("c", "d", 7.0, 6.0), ("a", "e", 9.0, 5.0), ("c", "e", 7.0, 5.0)]
    got = correct.greedy_pops(spark.createDataFrame(rows, "keep string, pop string, ucov double, vcov double"), Workspace(spark, "t"))
    assert {tuple(r) for r in got.select("keep", "pop").collect()} == {("a", "b"), ("c", "d"), ("a", "e")}


def test_low_coverage(spark):
    p = Params(k=3, low_cov=2.0, low_cov_len=6)
    g = graph_of(spark, [("a", "AAAA", 5.0), ("b", "AAAA", 1.0), ("c", "AAAA", 1.0), ("d", "A" * 9, 1.0)], [("a", "f", "f", "b"), ("b", "f", "f", "c"), ("c", "f", "f", "d")])
    after, gone = correct.remove_low_coverage(g, p)
    assert {r.node_id for r in gone.collect()} == {"b", "c"} and after.edges.count() == 0


def crossing(spark, weight=2):
    nodes = [("x", "A" * 9, 4.0), *((n, "A" * 20, 2.0) for n in "pqst")]
    edges = [("p", "f", "f", "x"), ("q", "f", "f", "x"), ("x", "f", "f", "s"), ("x", "f", "f", "t")]
    t = []
    for i in range(weight):
        t += [("x", "r", "r", "p", f"a{i}"), ("x", "f", "f", "s", f"a{i}"), ("x", "r", "r", "q", f"b{i}"), ("x", "f", "f", "t", f"b{i}")]
    return graph_of(spark, nodes, edges, t)


def test_crossing_is_split(spark):
    g = crossing(spark)
    marks = threads.symmetrised(g)
    assert marks.where("node_id = 'p'").count() == 2
    assert {tuple(r) for r in threads.port_pair_weights(marks).where("node_id = 'x'").select("fn", "rn", "weight").collect()} == {("s", "p", 2), ("t", "q", 2)}
    assert threads.threadible(g, marks, 3).count() == 0
    classes = {r.node_id: tuple(r)[1:] for r in threads.node_classes(g, marks, 2).collect()}
    assert classes["x"] == ("xcut", False, 4, 4) and classes["p"][0] == "straight"
    assert {r.kind for r in threads.node_classes(g, marks, 3).where("node_id = 'x'").collect()} == {"open"}
    chosen = threads.threadible(g, marks, 2)
    assert [r.node_id for r in chosen.collect()] == ["x"]
    out = threads.split(g, marks, threads.independent(g, chosen))
    assert {(r.node_id, r.cov) for r in out.nodes.collect()} >= {("x_1", 2.0), ("x_2", 2.0)}
    assert {(r.src, r.dst) for r in out.edges.where("sdir = 'f'").collect()} == {("p", "x_1"), ("x_1", "s"), ("q", "x_2"), ("x_2", "t")}
    assert {r.dst for r in out.threads.where("node_id = 'p'").collect()} == {"x_1"}
    assert inspect.check_graph(out, 9).first().edges_missing == 0


def test_neighbours_split_in_turn(spark):
    g = graph_of(spark, [("a", "AAA", 1.0), ("b", "AAA", 1.0), ("c", "AAA", 1.0)], [("a", "f", "f", "b"), ("b", "f", "f", "c")])
    s = spark.createDataFrame([("b",), ("c",), ("a",)], "node_id string")
    assert [r.node_id for r in threads.independent(g, s).collect()] == ["a"]


def test_half_node(spark):
    g = graph_of(spark, [(n, "AAA", 6.0) for n in "xpst"], [("p", "f", "f", "x"), ("x", "f", "f", "s"), ("x", "f", "f", "t")])
    pairs = threads.split_pairs(g, threads.symmetrised(g), spark.createDataFrame([("x",)], "node_id string"))
    assert {(r.fn, r.rn, r["copy"]) for r in pairs.collect()} == {("s", "p", 1), ("t", "p", 2)}


def test_mates(spark):
    p = Params(k=3, insert_len=50, min_unique_cov=1, max_unique_cov=9, min_unique_len=5, wiggle=5)
    nodes = [("a", "A" * 20, 2.0), ("b", "A" * 30, 2.0), ("m", "A" * 8, 20.0), ("n", "A" * 200, 20.0)]
    edges = [("a", "f", "f", "m"), ("m", "f", "f", "b"), ("a", "f", "f", "n")]
    starts = [("a", "x_1", False, 2), ("b", "x_2", True, 20), ("a", "y_1", False, 1), ("a", "y_2", True, 15), ("a", "z_1", False, 0), ("m", "z_2", True, 3)]
    g = graph_of(spark, nodes, edges, [], starts)
    ends = mates.mate_ends(g, p)
    r = mates.internal_distances(ends).first()
    assert (r.n, r.sum_d, r.sum_d2, r.invalid) == (1, 15, 225, 0)
    links = mates.linking_edges(ends, p)
    assert {tuple(x) for x in links.collect()} == {("a", "f", "f", "b", 12), ("b", "r", "r", "a", 12)}
    found, metrics = mates.search_paths(g, mates.bundles(links).withColumn("dist", F.lit(5)), p)
    assert metrics[0]["active"] >= 2
    paths = mates.sure_paths(found)
    assert {(x.start, x.dest, tuple(s.node for s in x.path)) for x in paths.collect()} == {("a", "b", ("m", "b")), ("b", "a", ("m", "a"))}
    dead = mates.dead_links(g, paths)
    assert {tuple(x) for x in dead.collect()} == {("a", "f", "f", "n"), ("n", "r", "r", "a")}
    assert mates.clean_links(g, dead).edges.count() == 4
    (way,) = passes.passes(g, paths).collect()
    assert (way.node_id, way.a.dst, way.steps, way.b.dst) == ("m", "b", [], "a")


def test_unroll(spark):
    u = "ACGTTGCAAC"
    g = graph_of(spark, [("u", u, 4.0), ("v", "A" * 9, 1.0)], [("u", "f", "f", "u"), ("v", "f", "f", "u")])
    out, done = correct.unroll_tandems(g, Params(k=3))
    assert done.count() == 1 and out.nodes.where("node_id = 'u'").first().seq == u + u[2:]
    assert {(r.src, r.dst) for r in out.edges.collect()} == {("v", "u"), ("u", "v")}


def test_stats(spark):
    lens = [1000, 500, 500, 200, 120, 99, 60, 10]
    m = spark.createDataFrame([(str(i), n, 2, 3.0) for i, n in enumerate(lens)], "node_id string, len long, deg long, cov double")
    rows = {r.cutoff: r for r in stats.cutoff_stats(m).collect()}
    assert (rows[1].cnt, rows[1].total, rows[1].n50, rows[1].n50_count) == (8, 2489, 500, 2)
    assert (rows[100].cnt, rows[100].n50) == (5, 500) and rows[1000].n50_count == 1 and 5000 not in rows
    assert [(r["rank"], r.len, r.running) for r in stats.top_contigs(m, 3).orderBy("rank").collect()] == [(1, 1000, 1000), (2, 500, 1500), (3, 500, 2000)]
    assert tuple(stats.global_n50(m, 3000).first()) == (500, 2)
    assert tuple(stats.global_n50(m, 10**6).first()) == (None, 5)
    small = m.where("len < 100")
    assert {r.cutoff: r.n50 for r in stats.cutoff_stats(small).collect()} == {1: 0, 50: 0}
    assert stats.cutoff_stats(m.limit(0)).count() == 0


def test_branch_types_and_details(spark):
    g = crossing(spark)
    kinds = {r.type: r.cnt for r in stats.branch_types(g).collect()}
    assert kinds == {"full": 1, "tip": 4}
    d = inspect.details(g, node_ids=["x"]).first()
    assert d.type == "full" and [e.reads for e in d.edges] == [2, 2, 2, 2] and len(d.pairs) == 2


def test_checks_find_faults(spark):
    g = graph_of(spark, [("a", "AACG", 1.0), ("b", "ACGT", 1.0)], [("a", "f", "f", "b"), ("a", "f", "r", "z")], [("a", "f", "f", "z", "r")])
    c = inspect.check_graph(g, 4).first()
    assert (c.nodes, c.edges_ok, c.edges_missing, c.threads_bad) == (2, 2, 1, 1)
    fixed = inspect.dangling_stubs(g, 4)
    assert {r.node_id for r in fixed.nodes.collect()} == {"a", "b", "z"}
    assert {(r.node_id, r.distance) for r in inspect.neighborhood(g, "a", 1).collect()} == {("a", 0), ("b", 1), ("z", 1)}


def test_text_round_trips(spark, tmp_path):
    g = compact.compact(build.build(reads_df(spark, [random_dna(60, 21), random_dna(60, 22)]), Params(k=7)), 7)
    sinks.node_messages(g).write.text(str(tmp_path / "nodes"))
    back = sinks.read_node_messages(spark, str(tmp_path / "nodes"))
    for name in ("edges", "threads", "starts"):
        a, b = getattr(g, name), getattr(back, name)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert {(r.node_id, r.seq) for r in back.nodes.collect()} == {(r.node_id, r.seq) for r in g.nodes.collect()}
    sinks.write_fasta(g.nodes, str(tmp_path / "fa"), 10)
    names = {r.read: r.seq for r in sources.read_fasta(spark, str(tmp_path / "fa")).collect()}
    assert names == {r.node_id: r.seq for r in g.nodes.collect()}
    assert sinks.dot_lines(g).count() == g.nodes.count() + g.edges.where("sdir = 'f' and ddir = 'f' or sdir != ddir and src <= dst").count()
    sinks.write_dot(g, str(tmp_path / "dot"))
    (tmp_path / "x.fq").write_text("@a:1 z\nACGT\n+\n@@@@\n@b\nAC\n+\nII\n@c\nACG\n+\nII\n")
    ok, bad = sources.read_fastq(spark, str(tmp_path / "x.fq"))
    assert {tuple(r) for r in ok.collect()} == {("a_1", "ACGT"), ("b", "AC")} and bad.count() == 1
    (tmp_path / "x.sfa").write_text("a\tACGT\nbroken\nb\tAC\n")
    ok, bad = sources.read_sfa(spark, str(tmp_path / "x.sfa"))
    assert {tuple(r) for r in sources.renumbered(ok).collect()} == {("1", "ACGT"), ("2", "AC")} and bad.count() == 1


def test_assembly_of_two_templates(spark):
    a, b = random_dna(150, 31), random_dna(150, 32)
    noisy = a[60:100]
    noisy = noisy[:20] + ("A" if noisy[20] != "A" else "C") + noisy[21:]
    reads = reads_df(spark, tiled(a, 40) + tiled(b, 40) + [noisy])
    g = assembly.assemble(reads, Params(k=21, low_cov=2.0, min_thread_weight=1))
    assert contigs(g) == sorted(min(x, S.rc(x)) for x in (a, b))


def test_stages_can_be_resumed(spark, tmp_path):
    a = random_dna(120, 41)
    job = assembly.Assembly(spark, Params(k=15), str(tmp_path))
    tip = a[40:69] + ("A" if a[69] != "A" else "C")
    job.run(reads_df(spark, [*tiled(a, 30), tip, a[:15], "ACGTNACGT" * 4]), stop="popBubbles")
    job.run(start="lowcov")
    got = sources.read_fasta(spark, str(tmp_path / "contigs.fa")).collect()
    assert [min(r.seq, S.rc(r.seq)) for r in got] == [min(a, S.rc(a))]
    counted = {(r.stage, r.counter): r.value for r in job.counters(*assembly.STAGES[:-1]).collect()}
    of = lambda stage: {c: v for (s, c), v in counted.items() if s == stage}
    sizes = {"nodes": 1, "edges": 0, "threads": 0, "bases": len(a)}
    assert of("buildInitial").items() >= {"reads_good": 92, "reads_short": 1, "reads_skipped": 1, "reads_goodbp": 92 * 30}.items()
    assert of("buildInitial")["nodes"] > 1 and of("removeTips").items() >= {**sizes, "tips_clipped": 1}.items()
    assert all(of(stage).items() >= sizes.items() for stage in assembly.STAGES[1:-1])


def test_empty_input(spark):
    g = assembly.assemble(reads_df(spark, [""]), Params(k=5, insert_len=50, max_unique_cov=9))
    assert g.nodes.count() == 0


def test_counters_of_reads_that_are_all_left_out(spark):
    p, tally = Params(k=5), counters.Counters()
    judged = build.judged_reads(reads_df(spark, ["ACNGT", "AC", "GGNGGT"]), p)
    assert build.nodes(tally.watch_reads(judged).where("fate = 'good'"), 5).count() == 0
    got = {r.counter: r.value for r in tally.table(spark, "s").collect()}
    assert got == {"reads_good": 0, "reads_short": 1, "reads_skipped": 2, "reads_goodbp": 0}


def test_fixpoints_settle_or_raise(spark, monkeypatch):
    """Whatever the bound on rounds is."""
    left, right, mid = random_dna(40, 11), random_dna(40, 12), random_dna(30, 13)
    other = mid[:15] + ("A" if mid[15] != "A" else "C") + mid[16:]
    p = Params(k=11, bubble_rate=0.1)
    tip = left[10:30] + ("A" if left[30] != "A" else "C")
    g = compact.compact(build.build(reads_df(spark, [left + mid + right] * 3 + [left + other + right, tip]), p), 11)
    monkeypatch.setattr(assembly, "MOST_ROUNDS", 0)
    g, n = assembly.remove_tips(g, p)
    assert n == 1
    done, n = assembly.pop_bubbles(g, p)
    assert n == 1 and contigs(done) == [min(left + mid + right, S.rc(left + mid + right))]
    rounds = assembly._rounds(done, "repeats")
    assert next(rounds) == 0
    with pytest.raises(RuntimeError, match="repeats did not settle"):
        next(rounds)


def test_dot_options_and_fields(spark):
    g = crossing(spark)
    lines = {r.line for r in sinks.dot_lines(g, tiny=True, tags=["x"], low_cov=3.0, threads=True).collect()}
    assert '"x" [label="." color="goldenrod3" style="filled"]' in lines and '"p" [label="." color="grey"]' in lines
    assert sum("color=" in x and "->" in x for x in lines) == 2
    bundles = spark.createDataFrame([("p", "f", "f", "s", 4, 17), ("s", "r", "r", "p", 4, 17)], "src string, sdir string, ddir string, dst string, weight long, dist long")
    assert sum("dashed" in r.line for r in sinks.dot_lines(g, bundles=bundles).collect()) == 1
    named = Graph(g.nodes, g.edges, spark.createDataFrame([("x", "f", "f", "s", "mom_1"), ("p", "f", "f", "x", "dad_3"), ("p", "f", "f", "x", "mom_1")], THREADS), g.starts)
    coloured = {r.line.split('"')[1]: r.line for r in sinks.dot_lines(named, library_colours={"mom": "red"}).collect() if "->" not in r.line}
    assert 'color="red"' in coloured["x"] and 'color="black"' in coloured["p"] and 'color="black"' in coloured["s"]
    heads = {r.node_id: r.line for r in sinks.fasta_lines(g.nodes, fields=g).where("line_no = 0").collect()}
    assert " *ff s t" in heads["x"] and " *d " in heads["x"] and heads["s"].endswith("*rr x")
    d = inspect.details(g, node_ids=["x"], fields=("seq", "starts", "threads", "pairs")).first()
    assert d.seq == "A" * 9 and d.starts is None and len(d.threads) == 8 and [list(p.reads) for p in d.pairs] == [["a0", "a1"], ["b0", "b1"]]
    with pytest.raises(ValueError, match="unknown fields"):
        inspect.details(g, fields=("nothing",))
    assert [r.node_id for r in inspect.route(g, "p", "t", 3).orderBy("step").collect()] == ["p", "x", "t"]
    assert inspect.route(g, "p", "t", 1).count() == 0


def test_spread(spark):
    few = spark.createDataFrame([("a",), ("b",)], "s string").coalesce(1)
    assert sources.spread(few).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.s for r in sources.spread(few).collect()) == ["a", "b"]


def test_a_long_chain_is_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(compact, "BLOCK", 7)
    seq = random_dna(400, 51)
    g = build.build(reads_df(spark, tiled(seq, 30)), Params(k=15))
    c = compact.compact(g, 15)
    assert contigs(c) == [min(seq, S.rc(seq))] and inspect.check_starts(c, reads_df(spark, tiled(seq, 30))).first().starts_bad == 0
