"""A graph of K-mers that fit a long: one row a K-mer, with its edges as bits.

Whatever concerns a node and its own edges is read off its row; two ends of an edge meet
by the one code of its k + 1 bases.  Letters are written out for what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kmers


def _bit(bits: str, at: Column) -> Column:
    return F.call_function("shiftright", F.col(bits), at.cast("int")).bitwiseAND(F.lit(1)) > 0


def _sides(some) -> Column:
    """The ports, as bits, of those sides whose number of ports is ``some``."""
    fwd, rev = F.col("ports").bitwiseAND(F.lit(15)), F.col("ports").bitwiseAND(F.lit(240))
    return F.when(some(F.bit_count(fwd)), fwd).otherwise(0).bitwiseOR(F.when(some(F.bit_count(rev)), rev).otherwise(0))


@dataclass(frozen=True)
class Coded:
    """rows(code, cov, ports, turned) as ``kmers.ported`` gives them."""

    rows: DataFrame
    k: int

    def where(self, condition: Column) -> "Coded":
        """Some of the nodes; their ports still name those that are gone (see ``inner``)."""
        return Coded(self.rows.where(condition), self.k)

    def nodes(self) -> DataFrame:
        name = kmers.letters(F.col("code"), self.k)
        return self.rows.select(name.alias("node_id"), name.alias("seq"), F.col("cov").cast("double").alias("cov"))

    def _next(self, start: Column, back: Column, base: Column) -> tuple[Column, Column]:
        """The K-mer after ``start``, whose reverse complement is ``back``, and its own reverse complement."""
        ahead = F.shiftleft(start, 2).bitwiseAND(F.lit(4**self.k - 1)).bitwiseOR(base)
        return ahead, F.shiftleft(F.lit(3).cast("long") - base, 2 * self.k - 2).bitwiseOR(F.shiftright(back, 2))

    def _ways(self, some=None, rows: DataFrame | None = None, *more: str) -> DataFrame:
        """(code, port, start, back, base, …): the ports of each node, or of ``some`` sides, the strand each leaves, its reverse complement, and the base that follows."""
        rows = (self.rows if rows is None else rows).select("code", "turned", (F.col("ports") if some is None else _sides(some)).alias("ports")).where("ports != 0")
        each = rows.withColumn("port", F.explode(F.sequence(F.lit(0), F.lit(7))))
        on = F.col("port") < 4
        return each.where(_bit("ports", F.col("port"))).select(
            "code", "port", F.when(on, F.col("code")).otherwise(F.col("turned")).alias("start"), F.when(on, F.col("turned")).otherwise(F.col("code")).alias("back"), F.col("port").bitwiseAND(F.lit(3)).cast("long").alias("base"), *more
        )

    def edges(self, rows: DataFrame | None = None) -> DataFrame:
        """All edges, each as seen from its two ends; those of some ``rows`` only, if given."""
        v, rv = self._next(F.col("start"), F.col("back"), F.col("base"))
        e = self._ways(rows=rows).select("code", "port", v.alias("v"), rv.alias("rv"))
        return e.select(
            kmers.letters(F.col("code"), self.k).alias("src"), F.when(F.col("port") < 4, "f").otherwise("r").alias("sdir"),
            F.when(F.col("v") < F.col("rv"), "f").otherwise("r").alias("ddir"), kmers.letters(F.least("v", "rv"), self.k).alias("dst"),
        )

    def neighbours(self) -> Column:
        """Of a row, its eight ports, each as ``sdir ddir : packed neighbour``, null where there is no edge."""

        def port(p: Column) -> Column:
            on = p < 4
            v, rv = self._next(F.when(on, F.col("code")).otherwise(F.col("turned")), F.when(on, F.col("turned")).otherwise(F.col("code")), p.bitwiseAND(F.lit(3)).cast("long"))
            name = F.concat(F.when(on, "f").otherwise("r"), F.when(v < rv, "f").otherwise("r"), F.lit(":"), kmers.packed(F.least(v, rv), self.k))
            return F.when(_bit("ports", p), name)

        return F.transform(F.array(*map(F.lit, range(8))), port)

    def edges_from(self, nodes: DataFrame) -> DataFrame:
        """Edges of nodes(node_id)."""
        some = nodes.select(kmers.code_of(F.col("node_id")).alias("code"))
        return self.edges(self.rows.join(some, "code", "left_semi"))

    def _codes(self, some=None) -> DataFrame:
        """(code, ends) of the edges at such sides; ``ends`` has 1 and 2 added for its ends that are there."""
        way = F.shiftleft("start", 2).bitwiseOR(F.col("base"))
        back = F.shiftleft(F.lit(3).cast("long") - F.col("base"), 2 * self.k).bitwiseOR(F.col("back"))
        both = self._ways(some).select(way.alias("way"), back.alias("other"))
        return both.groupBy(F.least("way", "other").alias("code")).agg(F.bit_or(F.when(F.col("way") <= F.col("other"), 1).otherwise(2)).alias("ends"))

    def forked(self) -> DataFrame:
        """(code, ends) of edges with a branching end."""
        return self._codes(lambda n: n > 1)

    def sole(self) -> DataFrame:
        """(code) of edges that are the only one at both ends."""
        return self._codes(lambda n: n == 1).where("ends = 3").select("code")

    def inner(self) -> DataFrame:
        """(code) of edges between nodes that are both there; one that is its own mirror has one end."""
        own = F.col("code") == kmers.turned_code(F.col("code"), self.k + 1)
        return self._codes().where((F.col("ends") == 3) | own).select("code")

    def sides(self, *more: str) -> DataFrame:
        """(node_id, seq, cov, deg_f, deg_r, tandem, fd, fn, rd, rn): degrees, and the edge of a side that has just one; ``more`` of the rows' own columns."""
        fwd, rev = F.col("ports").bitwiseAND(F.lit(15)), F.shiftright("ports", 4)
        x = self.rows.withColumns({"fwd": fwd, "rev": rev})
        code, turned, tandem = F.col("code"), F.col("turned"), F.lit(False)
        for here, there, ports in ((code, turned, "fwd"), (turned, code, "rev")):
            for to in (here, there):  # the node, entered forward or back, after itself
                last = to.bitwiseAND(F.lit(3))
                tandem = tandem | (F.shiftleft(here, 2).bitwiseAND(F.lit(4**self.k - 1)).bitwiseOR(last) == to) & _bit(ports, last)
        x = x.withColumns({"deg_f": F.bit_count("fwd").cast("long"), "deg_r": F.bit_count("rev").cast("long"), "tandem": tandem})
        base = lambda bits: (F.shiftright(bits, 1) - F.shiftright(bits, 3)).cast("long")
        for d, here, there, ports in (("f", code, turned, "fwd"), ("r", turned, code, "rev")):
            v, rv = self._next(here, there, base(ports))
            x = x.withColumns({f"v{d}": v, f"rv{d}": rv})
        cells, name = [], kmers.letters(code, self.k)
        for d in "fr":
            v, rv, one = F.col(f"v{d}"), F.col(f"rv{d}"), F.col(f"deg_{d}") == 1
            cells += [F.when(one, F.when(v < rv, "f").otherwise("r")).alias(f"{d}d"), F.when(one, kmers.letters(F.least(v, rv), self.k)).alias(f"{d}n")]
        return x.select(name.alias("node_id"), name.alias("seq"), F.col("cov").cast("double").alias("cov"), "deg_f", "deg_r", "tandem", *cells, *more)
