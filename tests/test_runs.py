"""Chains merged from runs that tasks find, against those found by names."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from strandweave.operators import build, compact, kmers, mates, ranking, runs
from strandweave.params import Params
from strandweave.sources import reads as sources
from strandweave.storage import Workspace

from .test_coded import _rows
from .test_graph import random_dna


def _reads(rng):
    """Chains and rings within a read and over several, a ring shorter than its K-mers, and branches."""
    ring, other, line, twice = (random_dna(60, rng.random()) for _ in range(4))
    out = [ring + ring[:9], other[:41], other[30:] + other[:12], line[:40], line[20:], "ACG" * 6, "A" * 12, twice + line[5:25] + twice[::-1]]
    return [(f"r{i}", s) for i, s in enumerate(out)]


def test_same_as_by_names(spark, monkeypatch):
    """However K-mers are dealt: by their reads, few or many at once, or by their codes."""
    k, work = 7, Workspace(spark, "runs")
    good = build.clean_reads(spark.createDataFrame(_reads(random.Random(5)), "read string, seq string"), Params(k=k))
    threads, starts = work.put(build.edge_threads(good, k, 9, all_nodes=True), "threads"), build.read_starts(good, k, 9)
    plain = build.coded(work.put(kmers.ported(good, k), "plain"), k, threads, starts)
    want = compact.compact(replace(plain, coded=None), k)
    tables = {t: _rows(getattr(want, t).select(*getattr(plain, t).columns)) for t in ("nodes", "edges", "threads", "starts")}
    rings = []
    monkeypatch.setattr(ranking, "rank", lambda *a, f=ranking.rank: (lambda r: rings.append(r[1] is not None) or r)(f(*a)))
    for origins, held in ((True, 400_000), (True, 5), (False, 400_000)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(held, 10_000))
        monkeypatch.setattr(runs, "HELD", held)
        graph = replace(plain, coded=build.coded(work.put(kmers.ported(good, k, origins), f"rows{origins}{held}"), k, threads, starts).coded)
        got = compact.compact(graph, k)
        for t, rows in tables.items():
            assert _rows(getattr(got, t)) == rows, (t, origins, held)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert any(rings)  # a ring over several runs was cut


def test_few_links_are_left_to_rank(spark):
    """What is ranked goes with the reads that begin inside a chain, not with K-mers."""
    rng, k = random.Random(3), 15
    reads = [(f"{i}", random_dna(2000, rng.random())) for i in range(10)]
    reads += [(f"{n}_1", s[:400]) for n, s in reads]
    rows = kmers.ported(spark.createDataFrame(reads, "read string, seq string"), k, origins=True)
    parts, met = runs.merge(rows, k, Workspace(spark, "few"))
    assert parts.agg(F.sum("n")).first()[0] > 19_000
    assert parts.count() <= 40 and met.where("chained").count() == 0


def test_letters_as_by_pattern(spark):
    """Letters kept are those that a pattern keeps of the text in upper case, in any script."""
    texts = [None, "", "acgt ACGT", "x\nN", "taﬅg ẗİ éc\U0001f600g", "ga" * 50_000]
    x = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = x.select(F.col("id").cast("string"), F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]+", ""))
    assert sorted(map(tuple, sources.from_text(x, "id").collect())) == sorted(map(tuple, want.collect()))


def test_search_stores_a_hop_once(spark, monkeypatch):
    """A hop is stored once, and lengths meet edges once, before the first one."""
    p = Params(k=3, insert_len=9, max_unique_cov=9.0)
    nodes = spark.createDataFrame([("a", "ACGTA", 1.0), ("b", "TACCA", 1.0), ("c", "CATTA", 1.0)], "node_id string, seq string, cov double")
    edges = spark.createDataFrame([("a", "f", "f", "b"), ("b", "f", "f", "c")], "src string, sdir string, ddir string, dst string")
    none = spark.createDataFrame([], "node_id string")
    bundled = spark.createDataFrame([("a", "f", "f", "c", 1, 5)], "src string, sdir string, ddir string, dst string, weight long, dist long")
    stored = []
    monkeypatch.setattr(Workspace, "put", lambda s, d, n, *a, f=Workspace.put: stored.append(n) or f(s, d, n, *a))
    found, metrics = mates.search_paths(mates.Graph(nodes, edges, none, none), bundled, p)
    assert [(r.start, r.dest, [x.node for x in r.path]) for r in found.collect()] == [("a", "c", ["b", "c"])]
    assert stored == ["ways", "seeds", "hop1", "hop2"] and metrics == [{"active": 1}, {"found": 1}]


def test_search_carries_paths_as_texts(spark):
    """Of paths to one end the smallest is kept, as by its steps, though a name goes on where another one ends."""
    p = Params(k=3, insert_len=9, max_unique_cov=9.0)
    nodes = spark.createDataFrame([(n, "ACGTA", 1.0) for n in ("a", "b", "b_1", "c")], "node_id string, seq string, cov double")
    edges = spark.createDataFrame([("a", "f", "f", "b_1"), ("a", "f", "f", "b"), ("b", "f", "f", "c"), ("b_1", "f", "f", "c")], "src string, sdir string, ddir string, dst string")
    none = spark.createDataFrame([], "node_id string")
    bundled = spark.createDataFrame([("a", "f", "f", "c", 1, 5)], "src string, sdir string, ddir string, dst string, weight long, dist long")
    graph = mates.Graph(nodes, edges, none, none)
    assert dict(mates.hop(mates.seeds(bundled, 3), graph, p, True).dtypes)["path"] == "string"
    found, _ = mates.search_paths(graph, bundled, p)
    assert dict(found.dtypes)["path"] == mates.PATH
    assert [(r.paths, [tuple(x) for x in r.path]) for r in found.collect()] == [(2, [("f", "f", "b"), ("f", "f", "c")])]
