"""The whole assembly: stages with names, each from stored tables to stored tables.

    python -m strandweave.plans.assembly --reads reads.sfa --work out -k 25

Stages may be run apart (``--start``, ``--stop``): a stage reads what the one before it
has stored under ``work``.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, compact, correct, inspect, kmers, mates, passes, stats, threads
from ..operators.graph import EDGES, NODES, STARTS, THREADS, Graph
from ..operators.live import ENDS, TABLES, Live, next_version, touching, without
from ..params import Params
from ..sources import reads as sources
from ..sources import sinks
from ..storage import Workspace
from .counters import SCHEMA as COUNTERS
from .counters import Counters

STAGES = ["buildInitial", "removeTips", "popBubbles", "lowcov", "repeats", "scaffolding", "convertFasta"]
#: Rounds that repeats and scaffolding may take in any graph; one of more nodes may take one a node.
MOST_ROUNDS = 100


def _rounds(graph: Graph, label: str) -> Iterator[int]:
    """Rounds of a fixpoint, which must settle: only a defect takes more rounds than the graph has nodes."""
    yield from range(MOST_ROUNDS)
    yield from range(MOST_ROUNDS, graph.nodes.count())
    raise RuntimeError(f"{label} did not settle")


def renamed(graph: Graph, victims: DataFrame, kept: DataFrame) -> Graph:
    """The rows of kept(node_id, seq, cov) under their next names."""
    out = [kept.select(next_version(F.col("node_id")).alias("node_id"), "seq", "cov")]
    new = kept.select("node_id", next_version(F.col("node_id")).alias("new"))
    for t in TABLES[1:]:
        rows = without(touching(getattr(graph, t), kept.select("node_id"), t), victims, t)
        for end in ENDS[t]:
            rows = rows.join(new.withColumnRenamed("node_id", end), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        out.append(rows)
    return Graph(*out)


def settle_tips(live: Live, p: Params) -> int:
    """Tips and compaction, until a round finds no tip to drop; each round looks at what the one before touched."""
    total = 0
    for _ in count():  # each round removes nodes
        among, name = live.look("tips"), live.name("tips")
        n = live.work.put(correct.tip_victims(live.view(), p, among), name).count()
        if n == 0:
            return total
        total += n
        live.replace(name, n, None, "tips")
        compact.settle(live, p.k)


def settle_bubbles(live: Live, p: Params) -> int:
    """Bubbles, compaction and tips, until a round pops none."""
    total = 0
    for _ in count():  # each round removes nodes
        graph, among, name = live.view(), live.look("bubbles"), live.name("bubbles")
        victims, kept = correct.pop_bubbles(graph, p, name, among)
        n = victims.count()
        if n == 0:
            return total
        total += n
        # who popped keeps its links, under its next name
        live.work.put(victims.union(kept.select("node_id")), f"{name}-changed")
        live.replace(f"{name}-changed", n, renamed(graph, victims, kept), "bubbles")
        compact.settle(live, p.k)
        settle_tips(live, p)


def settle_all(live: Live, p: Params) -> None:
    compact.settle(live, p.k)
    settle_tips(live, p)
    settle_bubbles(live, p)


def _finished(live: Live, tally: Counters | None) -> Graph:
    if tally is not None:
        tally.changes(live)
    return live.finished()


def remove_tips(graph: Graph, p: Params, label: str = "tips", tally: Counters | None = None) -> tuple[Graph, int]:
    live = Live.of(graph, label)
    n = settle_tips(live, p)
    return _finished(live, tally), n


def pop_bubbles(graph: Graph, p: Params, label: str = "bubbles", tally: Counters | None = None) -> tuple[Graph, int]:
    live = Live.of(graph, label)
    n = settle_bubbles(live, p)
    return _finished(live, tally), n


def low_coverage(graph: Graph, p: Params, label: str = "lowcov", tally: Counters | None = None) -> tuple[Graph, int]:
    live = Live.of(graph, label)
    n = live.work.put(correct.low_coverage_victims(graph, p), "victims").count()
    if n:
        live.replace("victims", n, None, "low coverage")
        settle_all(live, p)
    return _finished(live, tally), n


def resolve_repeats(graph: Graph, p: Params, label: str = "repeats", tally: Counters | None = None) -> tuple[Graph, int]:
    """Splits nodes that reads run through, an independent set a round, until none can be split."""
    live, total, last = Live.of(graph, label), 0, None
    live.symmetrise()
    for r in _rounds(graph, label):
        graph, among = live.view(), live.look("repeats")
        splitters = live.work.put(threads.threadible(graph, graph.threads, p.min_thread_weight, among), live.name("splitters"))
        n, names = splitters.agg(F.count("*"), F.sum(F.xxhash64("node_id").cast("decimal(38,0)"))).first()
        if n == 0 or (n, names) == last:  # the same nodes again: nothing can be won
            break
        total, last = total + n, (n, names)
        name = live.name("chosen")
        chosen = live.work.put(threads.independent(graph, splitters, seed=r), name)
        live.replace(name, chosen.count(), threads.split_rows(graph, graph.threads, chosen, live.work, live.name("split")), "split")
        live.look_again("repeats", splitters)  # those not chosen; the others are gone
        settle_all(live, p)
    return _finished(live, tally), total


def scaffold(graph: Graph, p: Params, label: str = "scaffold", tally: Counters | None = None) -> tuple[Graph, int]:
    """Follows mate pairs between unique contigs, until neither a link nor a node changes."""
    if p.insert_len <= 0:
        return graph, 0
    total = 0
    for r in _rounds(graph, label):
        work = Workspace(graph.nodes.sparkSession, f"{label}{r}")
        bundled = work.put(mates.bundles(mates.linking_edges(mates.mate_ends(graph, p), p)), "bundles")
        if bundled.limit(1).count() == 0:
            break
        found, metrics = mates.search_paths(graph, bundled, p, f"{label}-hops{r}")
        paths = work.put(mates.sure_paths(found), "paths")
        dead = work.put(mates.dead_links(graph, paths), "dead")
        n_dead = dead.count()
        cleaned = mates.clean_links(graph, dead).saved(work, "cleaned")
        ways = work.put(passes.passes(cleaned, paths), "ways")
        splitters = work.put(passes.splitters(cleaned, ways), "splitters")
        n = splitters.count()
        if n + n_dead == 0:
            break
        total += n + n_dead
        if tally is not None:
            tally.search(metrics)
            tally.add("removed_edges", n_dead)
        if n:
            chosen = work.put(threads.independent(cleaned, splitters, seed=r), "chosen")
            if tally is not None:
                tally.add("resolved", chosen.count())
            cleaned = passes.split(cleaned, ways, chosen).saved(work, "split")
        live = Live.of(cleaned, f"{label}-settle{r}")
        settle_all(live, p)
        graph = _finished(live, tally)
    return graph, total


@dataclass
class Assembly:
    """Stored stages of one assembly."""

    spark: SparkSession
    params: Params
    path: str

    def save(self, graph: Graph, stage: str, tally: Counters | None = None) -> Graph:
        """Stores a stage, and beside it what ``tally`` counted, with the sizes of the tables just written."""
        tally = tally or Counters()
        graph = tally.watch_graph(graph)
        for name, df in (("nodes", graph.nodes), ("edges", graph.edges), ("threads", graph.threads), ("starts", graph.starts)):
            df.write.mode("overwrite").parquet(f"{self.path}/{stage}/{name}")
        tally.table(self.spark, stage).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{stage}/counters")
        return self.load(stage)

    def counters(self, *stages: str) -> DataFrame:
        """(stage, counter, value) of stored stages."""
        return self.spark.read.schema(COUNTERS).parquet(*(f"{self.path}/{stage}/counters" for stage in stages))

    def load(self, stage: str) -> Graph:
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{stage}/{name}")
        return Graph(read("nodes", NODES), read("edges", EDGES), read("threads", THREADS), read("starts", STARTS))

    def _kmers(self, reads: DataFrame, watched: DataFrame, work: Workspace) -> Graph:
        """The stored graph of K-mers; its nodes are made from the ``watched`` reads."""
        p = self.params
        if not kmers.fits(p.k):
            return replace(build.build(reads, p), nodes=build.nodes(watched, p.k)).saved(work, "kmers")
        rows, good = work.put(kmers.ported(watched, p.k, origins=True), "kmers"), build.clean_reads(reads, p)
        threads_ = work.put(build.edge_threads(good, p.k, p.max_threads, p.record_all_threads, rows=rows), "threads")
        return build.coded(rows, p.k, threads_, work.put(build.read_starts(good, p.k, p.max_read_starts), "starts"))

    def run(self, reads: DataFrame | None = None, start: str = STAGES[0], stop: str = STAGES[-1]) -> Graph:
        first, last = STAGES.index(start), STAGES.index(stop)
        graph = self.load(STAGES[first - 1]) if first else None
        for stage in STAGES[first : last + 1]:
            tally = Counters()
            if stage == "buildInitial":
                work = Workspace(self.spark, "build")
                watched = tally.watch_reads(build.judged_reads(reads, self.params)).where("fate = 'good'")
                graph = compact.compact(self._kmers(reads, watched, work), self.params.k)
            elif stage == "convertFasta":
                sinks.write_fasta(graph.nodes, f"{self.path}/contigs.fa")
                break
            else:
                step = {"removeTips": remove_tips, "popBubbles": pop_bubbles, "lowcov": low_coverage, "repeats": resolve_repeats, "scaffolding": scaffold}[stage]
                graph, _ = step(graph, self.params, stage, tally)
            graph = self.save(graph, stage, tally)
        return graph


def assemble(reads: DataFrame, p: Params) -> Graph:
    """All stages but the last, with temporary tables."""
    work = Workspace(reads.sparkSession, "assembly")
    return Assembly(reads.sparkSession, p, work.path("stages")).run(reads, stop="scaffolding")


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("--reads", help="text of name<TAB>sequence, or FASTA (.fa, .fasta) or FASTQ (.fq, .fastq)")
    a.add_argument("--work", required=True)
    a.add_argument("--start", default=STAGES[0], choices=STAGES)
    a.add_argument("--stop", default=STAGES[-1], choices=STAGES)
    a.add_argument("--run-stats", metavar="DIR", help="only print the statistics and counters of a stored stage")
    a.add_argument("--convert-fa", metavar="DIR", help="only write a stored stage as FASTA")
    for f in fields(Params):
        kind = {"int": int, "float": float, "int | None": int, "bool": None}[f.type]
        name = "-k" if f.name == "k" else "--" + f.name.replace("_", "-")
        a.add_argument(name, dest=f.name, **({"action": "store_true"} if kind is None else {"type": kind, "default": None}))
    given = vars(a.parse_args(argv))
    p = Params(**{f.name: given[f.name] for f in fields(Params) if given[f.name] not in (None, False)})
    spark = SparkSession.builder.appName("strandweave").getOrCreate()
    job = Assembly(spark, p, given["work"])
    if given["run_stats"]:
        m = stats.measured(job.load(given["run_stats"]))
        stats.cutoff_stats(m).orderBy(F.desc("cutoff")).show(100, False)
        stats.top_contigs(m).orderBy("rank").show(100, False)
        job.counters(given["run_stats"]).orderBy("counter").show(100, False)
        return
    if given["convert_fa"]:
        sinks.write_fasta(job.load(given["convert_fa"]).nodes, f"{given['work']}/{given['convert_fa']}.fa")
        return
    reads = None
    if given["reads"]:
        path = given["reads"]
        if path.endswith((".fa", ".fasta")):
            reads = sources.read_fasta(spark, path)
        elif path.endswith((".fq", ".fastq")):
            reads, _ = sources.read_fastq(spark, path)
        else:
            reads, _ = sources.read_sfa(spark, path)
    graph = job.run(reads, given["start"], given["stop"])
    inspect.check_graph(graph, p.k).show(1, False)


if __name__ == "__main__":
    main()
