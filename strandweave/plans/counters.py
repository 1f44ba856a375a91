"""What a stage did, in numbers: by its changes, and by observing plans that run anyway."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.build import cleaning_columns
from ..operators.graph import Graph
from ..operators.live import Live

#: The names of counters that reports go by.
OF_CHANGES = {"chains": "mergenodes", "tips": "tips_clipped", "bubbles": "poppedbubbles", "low coverage": "lowcovremoved", "split": "resolved"}
OF_SEARCH = {"found": "foundvalid", "short": "foundshort", "long": "foundlong", "invalid": "foundinvalid", "toolong": "toolong"}
SCHEMA = "stage string, counter string, value long"


def _observed(watch: Observation) -> dict[str, int]:
    """What was seen; nothing where Spark dropped the watched part of a plan, once it had found it to give no rows."""
    try:
        return watch.get
    except Py4JJavaError:
        return {}


@dataclass
class Counters:
    """Counters of one stage.

    Observed ones cost no job of their own: they ride on the write of a table.  They are
    for reports alone, as a task that runs again after a lost executor may count twice.
    """

    counts: Counter[str] = field(default_factory=Counter)
    seen: list[tuple[Observation, DataFrame, tuple[Column, ...]]] = field(default_factory=list)

    def add(self, counter: str, n: int) -> None:
        self.counts[counter] += n

    def changes(self, live: Live) -> None:
        """What the changes of a graph took out, by their kind."""
        for why, n, _ in live.log:
            if why in OF_CHANGES:
                self.add(OF_CHANGES[why], n)

    def search(self, metrics: list[dict[str, int]]) -> None:
        """Ends of a search for mate paths, by state."""
        for hop in metrics:
            for state, n in hop.items():
                if state in OF_SEARCH:
                    self.add(OF_SEARCH[state], n)

    def watch(self, df: DataFrame, *counters: Column) -> DataFrame:
        """The same rows; the counters are known once a job has read them all."""
        watch = Observation()
        self.seen.append((watch, df, counters))
        return df.observe(watch, *counters)

    def watch_reads(self, judged: DataFrame) -> DataFrame:
        return self.watch(judged, *cleaning_columns())

    def watch_graph(self, graph: Graph) -> Graph:
        n = F.count(F.lit(1))
        nodes = self.watch(graph.nodes, n.alias("nodes"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))
        return Graph(nodes, *(self.watch(getattr(graph, t), n.alias(t)) for t in ("edges", "threads", "starts")))

    def table(self, spark: SparkSession, stage: str) -> DataFrame:
        """(stage, counter, value), after the jobs that were watched."""
        values = dict(self.counts)
        for watch, df, counters in self.seen:
            values |= _observed(watch) or df.agg(*counters).first().asDict()
        return spark.createDataFrame([(stage, name, int(v)) for name, v in sorted(values.items())], SCHEMA)
