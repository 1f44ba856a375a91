"""A graph under change: stored tables that only grow, and the names of nodes that are gone.

Rounds of a fixpoint change little.  A change stores the rows that are new and names the
nodes they replace; whatever names a dead node is no longer there.  So a round stores rows
in proportion to what it changed, and the graph is one scan of all parts without the dead.
Once a tenth of the rows stored at first is dead, or there are many parts, everything is
written anew.  A node that changes gets a new version of its name, ``id~2`` after ``id~1``;
finished graphs have plain names again.  For each kind of step the nodes touched since it
last looked are kept, so that it looks at them alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .graph import EDGES, NODES, STARTS, THREADS, Graph, symmetrised

#: Dead nodes for one stored one, and parts, at which the tables are written anew.
SHARE, PARTS = 0.1, 40
TABLES = ("nodes", "edges", "threads", "starts")
#: Columns that name nodes, by table.
ENDS = {"nodes": ("node_id",), "edges": ("src", "dst"), "threads": ("node_id", "dst"), "starts": ("node_id",)}
SCHEMAS = {"nodes": NODES, "edges": EDGES, "threads": THREADS, "starts": STARTS}
STEPS = ("compact", "tips", "bubbles", "repeats")
_VERSION = r"~(\d+)$"


def next_version(name: Column) -> Column:
    """A node's name after it changed: never one that was in use before."""
    version = F.coalesce(F.nullif(F.regexp_extract(name, _VERSION, 1), F.lit("")).cast("int"), F.lit(0)) + 1
    return F.concat(plain_name(name), F.lit("~"), version.cast("string"))


def plain_name(name: Column) -> Column:
    return F.regexp_replace(name, _VERSION, "")


def _columns(table: str) -> list[str]:
    return [c.split(" ")[0] for c in SCHEMAS[table].split(", ")]


def without(df: DataFrame, nodes: DataFrame, table: str) -> DataFrame:
    """Rows that name none of nodes(node_id)."""
    for end in ENDS[table]:
        df = df.join(nodes.select(F.col("node_id").alias(end)), end, "left_anti")
    return df.select(*_columns(table))


def touching(df: DataFrame, nodes: DataFrame, table: str) -> DataFrame:
    """Rows that name any of nodes(node_id)."""
    first, *others = ENDS[table]
    hit = df.join(nodes.select(F.col("node_id").alias(first)), first, "left_semi").select(*_columns(table))
    for end in others:
        rest = df.join(nodes.select(F.col("node_id").alias(first)), first, "left_anti")
        hit = hit.union(rest.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi").select(*_columns(table)))
    return hit


@dataclass
class Live:
    base: Graph
    work: Workspace
    size: int
    #: Stored parts by table, after the base, and the stored tables whose node_id are dead.
    parts: dict[str, list[str]] = field(default_factory=lambda: {t: [] for t in TABLES})
    dead: list[str] = field(default_factory=list)
    n_dead: int = 0
    #: By step, the tables of nodes touched since; None for all nodes.
    pending: dict[str, list[DataFrame] | None] = field(default_factory=lambda: dict.fromkeys(STEPS))
    #: What made each change, the nodes it took out, and where its rows are stored.
    log: list[tuple[str, int, dict[str, str]]] = field(default_factory=list)
    _step: int = 0

    @classmethod
    def of(cls, graph: Graph, label: str) -> "Live":
        """A stored graph, about which nothing is known yet."""
        return cls(graph, Workspace(graph.nodes.sparkSession, label), graph.nodes.count())

    def name(self, what: str) -> str:
        self._step += 1
        return f"{what}{self._step}"

    def _read(self, schema: str, names: list[str]) -> DataFrame:
        return self.work.spark.read.schema(schema).parquet(*map(self.work.path, names))

    def view(self) -> Graph:
        """The graph as it is now; later changes do not change it."""
        if not self.dead:
            return self.base
        dead, out = self._read("node_id string", self.dead), []
        for t in TABLES:
            rows = getattr(self.base, t).select(*_columns(t))
            out.append(without(rows.union(self._read(SCHEMAS[t], self.parts[t])) if self.parts[t] else rows, dead, t))
        return Graph(*out)

    def replace(self, changed: str, n: int, new: Graph | None, why: str) -> None:
        """Takes the nodes of a stored table(node_id), n of them, out, with all rows that name them, and puts the rows of ``new`` in.

        New rows may name old nodes that stay, and new ones, but none of those that go.
        """
        tag, stored, before = self.name("change"), {}, self.view()
        gone = self._read("node_id string", [changed])
        if new is not None:
            for t in TABLES:
                self.work.put(getattr(new, t).select(*_columns(t)), f"{tag}-{t}")
                stored[t] = f"{tag}-{t}"
            edges = self._read(EDGES, [stored["edges"]])
            touched = self._read(NODES, [stored["nodes"]]).select("node_id").union(edges.select("src")).distinct()
        else:
            beside = before.edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
            touched = self.work.put(beside.join(gone, "node_id", "left_anti"), f"{tag}-touched")
        for t, name in stored.items():
            self.parts[t].append(name)
        self.dead.append(changed)
        self.n_dead += n
        self.log.append((why, n, stored))
        for seen in self.pending.values():
            if seen is not None:
                seen.append(touched)
        if self.n_dead > SHARE * max(self.size, 1) or len(self.dead) > PARTS:
            self.rewrite(self.view())

    def rewrite(self, graph: Graph) -> None:
        """Stores the whole graph anew."""
        self.base = graph.saved(self.work, self.name("base"))
        self.parts, self.dead, self.n_dead = {t: [] for t in TABLES}, [], 0
        self.size = self.base.nodes.count()
        self.log.append(("written anew", self.size, {}))

    def rows_stored(self) -> list[tuple[str, int, int]]:
        """Of each change, what made it, the nodes it took out, and the rows it stored."""
        return [(why, n, sum(self._read(SCHEMAS[t], [name]).count() for t, name in stored.items())) for why, n, stored in self.log]

    def symmetrise(self) -> None:
        """Writes the threads anew, each known at both ends; changes keep it so."""
        graph = self.view()
        threads = self.work.put(symmetrised(graph), self.name("both-ends"))
        if self.dead:
            self.rewrite(replace(graph, threads=threads))
        else:
            self.base = replace(graph, threads=threads)

    def look(self, step: str) -> DataFrame | None:
        """The nodes a step has to look at, None for all; from now on only what is touched later."""
        tables, self.pending[step] = self.pending[step], []
        if tables is None:
            return None
        nodes = self.work.spark.createDataFrame([], "node_id string")
        for t in tables:
            nodes = nodes.union(t.select("node_id"))
        return nodes.distinct() if len(tables) < 2 else self.work.put(nodes.distinct(), self.name(f"look-{step}"))

    def look_again(self, step: str, nodes: DataFrame) -> None:
        """Has a step look at stored nodes(node_id) once more."""
        if self.pending[step] is not None:
            self.pending[step].append(nodes.select("node_id"))

    def finished(self) -> Graph:
        """The graph, stored, its nodes under plain names."""
        if not self.log:
            return self.base
        graph, plain = self.view(), []
        for t in TABLES:
            plain.append(getattr(graph, t).withColumns({end: plain_name(F.col(end)) for end in ENDS[t]}).select(*_columns(t)))
        return Graph(*plain).saved(self.work, self.name("out"))
