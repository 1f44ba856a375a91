"""Graphs as FASTA, Graphviz and node-message text, and back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import pack, unpack
from ..operators import kmers, marks, runs
from ..operators.coded import Coded
from ..operators.graph import Graph
from ..storage import ship


def fasta_lines(nodes: DataFrame, width: int = 60, cov_in_name: bool = False, fields: Graph | None = None) -> DataFrame:
    """(node_id, line_no, line): a header and the sequence in lines of ``width`` bases.

    With a graph in ``fields`` a header also has all its fields, as node messages name them.
    """
    n = F.length("seq")
    cov = F.format_string("%.2f", F.col("cov"))
    head = F.concat(F.lit(">"), "node_id", F.lit("_cov"), cov) if cov_in_name else F.concat(F.lit(">"), "node_id", F.lit("  len="), n.cast("string"), F.lit("\tcov="), cov)
    if fields is not None:
        nodes, more = _with_fields(nodes, fields)
        head = F.concat(head, F.regexp_replace(F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit(" "), f), F.lit("")) for f in more]), "\t", " "))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    body = F.transform(starts, lambda i: F.substr("seq", i + 1, F.lit(width)))
    return nodes.select("node_id", F.posexplode(F.concat(F.array(head), body)).alias("line_no", "line"))


def write_fasta(nodes: DataFrame, path: str, width: int = 60) -> None:
    """One record a text row, so that no shuffle is needed to keep its lines together."""
    n = F.length("seq")
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    head = F.concat(F.lit(">"), "node_id", F.lit("  len="), n.cast("string"), F.lit("\tcov="), F.format_string("%.2f", F.col("cov")), F.lit("\n"))
    nodes.select(F.concat(head, wrapped).alias("value")).write.mode("overwrite").text(path)


#: Colours that thread lines take in turn.
PALETTE = ("red", "green", "orange", "blue", "yellow", "indigo", "violet")


def dot_lines(
    graph: Graph, max_label: int = 20, tiny: bool = False, tags: list[str] | None = None, low_cov: float = 0.0, threads: bool = False, bundles: DataFrame | None = None,
    library_colours: dict[str, str] | None = None,
) -> DataFrame:
    """(line) of a Graphviz digraph: a line a node, and one an undirected edge.

    ``tiny`` leaves labels out; ``tags`` are nodes to fill; nodes below ``low_cov`` are
    grey.  ``threads`` adds a coloured line for each two ports that reads join, ``bundles``
    (src, sdir, ddir, dst, weight, dist) a dashed one.  With ``library_colours`` a node has
    the colour of the library (a read's name before its first ``_``) of its threads, black
    if there are several.
    """
    label = F.when(F.length("seq") <= max_label, F.col("seq")).otherwise(F.concat(F.left("seq", F.lit(max_label)), F.lit("...")))
    # a whole number needs no formatter
    cov = F.when(F.col("cov") == F.floor("cov"), F.concat(F.floor("cov").cast("string"), F.lit(".00"))).otherwise(F.format_string("%.2f", F.col("cov")))
    text = F.lit(".") if tiny else F.concat(label, F.lit("\\n"), F.length("seq").cast("string"), F.lit(" bp, "), cov, F.lit(" x"))
    n, colour = graph.nodes, F.lit("")
    if library_colours:
        of = graph.threads.groupBy("node_id").agg(F.count_distinct(F.substring_index("read", "_", 1)).alias("libraries"), F.min(F.substring_index("read", "_", 1)).alias("library"))
        n = n.join(of, "node_id", "left")
        known = F.create_map(*[F.lit(x) for pair in sorted(library_colours.items()) for x in pair])
        named = F.when(F.col("libraries") == 1, F.coalesce(F.try_element_at(known, F.col("library")), F.lit("black"))).otherwise("black")
        colour = F.format_string(' color="%s"', named)
    if tags:
        colour = F.when(F.col("node_id").isin(tags), ' color="goldenrod3" style="filled"').otherwise(colour)
    if low_cov > 0:
        colour = F.when(F.col("cov") < low_cov, F.concat(F.lit(' color="grey"'), F.when(F.col("node_id").isin(tags or []), ' style="filled"').otherwise(""))).otherwise(colour)
    out = n.select(F.concat(F.lit('"'), "node_id", F.lit('" [label="'), text, F.lit('"'), colour, F.lit("]")).alias("line"))
    # rr is the mirror of ff; of the two ends of a mixed edge the smaller prints it
    once = graph.edges.where("sdir = 'f' and ddir = 'f' or sdir != ddir and src <= dst")
    out = out.union(once.select(F.concat(F.lit('"'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "sdir", "ddir", F.lit('"]')).alias("line")))
    if threads:
        from ..operators.threads import PORT, port_pair_weights

        joined = port_pair_weights(graph.threads).withColumn("turn", F.pmod(F.xxhash64("node_id", *PORT), F.lit(len(PALETTE))).cast("int") + 1)
        shade = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), F.col("turn"))
        out = out.union(joined.select(F.format_string('"%s" -> "%s" [color="%s" label="%d"]', "rn", "fn", shade, "weight").alias("line")))
    if bundles is not None:
        half = bundles.where("src <= dst")
        out = out.union(half.select(F.format_string('"%s" -> "%s" [label="dist=%d weight=%d type=%s%s" style="dashed"]', "src", "dst", "dist", "weight", "sdir", "ddir").alias("line")))
    return out


def write_dot(graph: Graph, path: str, **options) -> None:
    """Options are those of ``dot_lines``."""
    lines = graph.nodes.sparkSession.createDataFrame([("digraph g {",)], "line string").union(dot_lines(graph, **options))
    end = graph.nodes.sparkSession.createDataFrame([("}",)], "line string")
    lines.union(end).withColumnRenamed("line", "value").write.mode("overwrite").text(path)


#: Kinds of edges, by the directions of their ends.
TYPES = ("ff", "fr", "rf", "rr")


def _field(mark: str, values: Column) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.concat_ws("\t", F.lit(mark), F.array_join(values, "\t")))


def _start() -> Column:
    return F.concat(F.when(F.col("rc"), "~").otherwise(""), "read", F.lit(":"), F.col("off").cast("string"))


def _with_fields(nodes: DataFrame, graph: Graph) -> tuple[DataFrame, list[Column]]:
    """Nodes joined with their edges, read starts and threads, and the marked fields of these, null where there are none."""
    by_type = graph.edges.groupBy(F.col("src").alias("node_id")).agg(
        *[F.array_sort(F.collect_list(F.when(F.concat("sdir", "ddir") == t, pack_name(F.col("dst"))))).alias(t) for t in TYPES]
    )
    starts = graph.starts.groupBy("node_id").agg(F.array_sort(F.collect_list(_start())).alias("r5"))
    threads = graph.threads.groupBy("node_id").agg(F.array_sort(F.collect_list(F.concat("sdir", "ddir", F.lit(":"), pack_name(F.col("dst")), F.lit(":"), "read"))).alias("d"))

    x = nodes.join(by_type, "node_id", "left").join(starts, "node_id", "left").join(threads, "node_id", "left")
    return x, [*(_field(f"*{t}", F.col(t)) for t in TYPES), _field("*5", F.col("r5")), _field("*d", F.col("d"))]


def node_messages(graph: Graph) -> DataFrame:
    """(value): one tab-separated line a node: packed id, N, and marked fields *s *v *ff *fr *rf *rr *5 *d."""
    x, fields = _with_fields(graph.nodes, graph)
    cov = F.format_string("%.2f", F.col("cov"))
    return x.select(F.concat_ws("\t", pack_name(F.col("node_id")), F.lit("N"), F.lit("*s"), pack(F.col("seq")), F.lit("*v"), cov, *fields).alias("value"))


def _packed_letters(code: np.ndarray, k: int) -> list[str]:
    """K-mers packed two bases a letter, as ``kmers.packed`` writes them."""
    w = (k + 1) // 2
    text = np.empty((len(code), w), np.uint8)
    pairs, odd = (np.frombuffer(x.encode(), np.uint8) for x in (kmers.PAIRS, kmers.ODD))
    for i in range(k // 2):
        text[:, i] = pairs[code >> 2 * (k - 2 * i - 2) & 15]
    if k % 2:
        text[:, -1] = odd[code & 3]
    joined = text.tobytes().decode()
    return [joined[i : i + w] for i in range(0, len(joined), w)]


def _lines(k: int) -> Callable:
    """One line a node of rows(code, at, n, read): its own, at -1, with its coverage above its ports; its threads, at a port; its read starts, at 8 or, on the other strand, 9, with their offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in marks._whole(batches):
            code, at, n = (batch[c].to_numpy() for c in ("code", "at", "n"))
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            owner, group = np.full(len(first), -1), np.cumsum(np.append(False, code[1:] != code[:-1]))
            owner[group[at < 0]] = n[at < 0]
            here, back = code[first], runs.turned(code[first], k)
            name = _packed_letters(here, k)
            node, port = np.nonzero(np.maximum(owner, 0)[:, None] >> np.arange(8) & 1)
            v = (np.where(port < 4, here[node], back[node]) << 2 | port & 3) & 4**k - 1
            rv = runs.turned(v, k)
            to = _packed_letters(np.minimum(v, rv), k)
            kind = (2 * (port >= 4) + (v >= rv)).tolist()  # which of TYPES
            way = np.full((len(first), 8), -1)
            way[node, port] = np.arange(len(node))
            begin = [f"{TYPES[t]}:{x}:" for t, x in zip(kind, to, strict=True)]
            ends = [[None] * 4 for _ in first]
            for g, t, x in zip(node.tolist(), kind, to, strict=True):
                if ends[g][t] is None:
                    ends[g][t] = [x]
                else:
                    ends[g][t].append(x)
            starts, threads = [[] for _ in first], [[] for _ in first]
            over = np.where((at >= 0) & (at < 8), way[group, at & 7], -1)  # what names an edge that is not there is left out
            for g, a, e, off, read in zip(group.tolist(), at.tolist(), over.tolist(), n.tolist(), batch["read"].to_pylist(), strict=True):
                if read is None:
                    continue
                if e >= 0:
                    threads[g].append(begin[e] + read)
                elif a >= 8:
                    starts[g].append(f"{'~' if a == 9 else ''}{read}:{off}")
            lines = []
            for g, x in enumerate(owner.tolist()):
                if x < 0:
                    continue
                words = [name[g], "N", "*s", name[g], "*v", f"{x >> 8:.2f}"]
                for t, some in zip(TYPES, ends[g], strict=True):
                    if some:
                        words += [f"*{t}", *sorted(some)]
                for mark, some in (("*5", starts[g]), ("*d", threads[g])):
                    if some:
                        words += [mark, *sorted(some)]
                lines.append("\t".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    return run


def coded_messages(graph: Coded, threads: DataFrame, starts: DataFrame) -> DataFrame:
    """The same lines of a graph of K-mers, its threads(code, port, read) and read starts.

    A node's edges are read off its row; all else is dealt with it by its code, and
    neighbours are named where the line is written.
    """
    ship(threads.sparkSession)
    own = graph.rows.select("code", F.lit(-1).alias("at"), F.shiftleft("cov", 8).bitwiseOR(F.col("ports")).alias("n"), F.lit(None).cast("string").alias("read"))
    over = threads.select("code", F.col("port"), F.lit(0).cast("long"), "read")
    begun = starts.select(kmers.code_of(F.col("node_id")), F.when(F.col("rc"), 9).otherwise(8), F.col("off").cast("long"), "read")
    return marks._dealt(own.union(over).union(begun)).mapInArrow(_lines(graph.k), "value string")


def pack_name(node_id: Column) -> Column:
    """An id's K-mer packed; what repeat resolution has appended stays."""
    kmer, rest = F.regexp_extract(node_id, "^[ACGT]*", 0), F.regexp_extract(node_id, "^[ACGT]*(.*)$", 1)
    return F.concat(pack(kmer), rest)


def unpack_name(packed: Column) -> Column:
    return F.concat(unpack(F.regexp_extract(packed, "^[A-T]*", 0)), F.regexp_extract(packed, "^[A-T]*(.*)$", 1))


#: Words that begin a part of a line.
_MARK = re.compile(r"\*[a-z0-9]")
CODED = "kind string, node_id string, ends string, what string, n double, read string"


def _unpacked(names: list[str], k: int) -> pa.Array:
    """The letters of packed K-mers; any other text is an error."""
    w, lines = (k + 1) // 2, "".join(names).encode()
    known = np.zeros((2, 256), bool)
    for i, some in enumerate((kmers.PAIRS, kmers.ODD)):
        known[i, list(some.encode())] = True
    text = np.frombuffer(lines, np.uint8)
    good = len(text) == w * len(names) and all(len(x) == w for x in names)
    if good and len(names):
        text = text.reshape(-1, w)
        good = known[0, text[:, : k // 2]].all() and (k % 2 == 0 or known[1, text[:, -1]].all())
    if not good:
        fits = re.compile(f"[{kmers.PAIRS}]{{{k // 2}}}" + (f"[{kmers.ODD}]" if k % 2 else ""))
        raise ValueError(f"not {k} packed bases: {next(x for x in names if not fits.fullmatch(x))}")
    at = np.zeros((2, 256), np.int64)
    at[0, list(kmers.PAIRS.encode())], at[1, list(kmers.ODD.encode())] = range(16), range(4)
    base, out = np.frombuffer(b"ACGT", np.uint8), np.empty((len(names), k), np.uint8)
    for i in range(k // 2 if len(names) else 0):
        pair = at[0, text[:, i]]
        out[:, 2 * i], out[:, 2 * i + 1] = base[pair >> 2], base[pair & 3]
    if k % 2 and len(names):
        out[:, -1] = base[at[1, text[:, -1]]]
    return pa.StringArray.from_buffers(len(names), pa.py_buffer(np.arange(len(names) + 1, dtype=np.int32) * k), pa.py_buffer(out.tobytes()))


def coded_message_rows(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(kind, node_id, ends, what, n, read) of lines whose nodes are K-mers, in one pass.

    A node's ``what`` is its sequence and n its coverage; an edge's and a thread's are the
    neighbour, with both directions as ``ends``; a start's ``ends`` is r on the other
    strand, else f, and n its offset.
    """
    w, known = (k + 1) // 2, {f"*{m}" for m in ("s", "v", *TYPES, "5", "d")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, seq, cov = [], [], []
            edges = {t: ([], []) for t in TYPES}
            over, begun = ([], [], [], []), ([], [], [], [])
            for i, line in enumerate(batch["value"].to_pylist()):
                words, parts, head = line.split("\t"), {}, []
                held = head
                for x in words:
                    if x[:1] == "*" and _MARK.match(x):
                        held = []
                        if x in known and x not in parts:
                            parts[x] = held
                    else:
                        held.append(x)
                if len(head) < 2 or head[1] != "N":
                    raise ValueError("not a node message")
                name.append(head[0])
                seq.append(parts["*s"][0])
                cov.append(float(parts["*v"][0]))
                for t, (of, to) in edges.items():
                    if some := parts.get(f"*{t}"):
                        of.append((i, len(some)))
                        to += some
                for x in parts.get("*5", ()):
                    read, _, off = x.rpartition(":")
                    for cells, y in zip(begun, (i, "r" if x[:1] == "~" else "f", read.removeprefix("~"), float(off)), strict=True):
                        cells.append(y)
                for x in parts.get("*d", ()):
                    ends, to, read = x.split(":", 2)
                    for cells, y in zip(over, (i, ends, to, read), strict=True):
                        cells.append(y)
            node = _unpacked(name, k)

            def rows(kind, of, ends, what, n, read, node=node):
                size = len(of)
                full = lambda x, t=pa.string(): pa.repeat(pa.scalar(x, t), size) if not isinstance(x, list | pa.Array) else x if isinstance(x, pa.Array) else pa.array(x, t)
                return pa.RecordBatch.from_arrays([full(kind), node.take(pa.array(of, pa.int64())), full(ends), full(what), full(n, pa.float64()), full(read)], [c.split(" ")[0] for c in CODED.split(", ")])

            yield rows("node", list(range(len(name))), "", _unpacked(seq, k), cov, "")
            for t, (of, to) in edges.items():
                yield rows("edge", [i for i, n in of for _ in range(n)], t, _unpacked(to, k), 0.0, "")
            yield rows("thread", over[0], over[1], _unpacked(over[2], k), 0.0, over[3])
            yield rows("start", begun[0], begun[1], "", begun[3], begun[2])

    ship(spark)
    return spark.read.text(path).mapInArrow(run, CODED)


def read_node_messages(spark: SparkSession, path: str, k: int | None = None) -> Graph:
    """A graph from such lines; a line of another kind is an error.

    With k all nodes are K-mers, or it is an error.
    """
    if k is not None:
        rows = coded_message_rows(spark, path, k)
        of = lambda kind: rows.where(F.col("kind") == kind)
        ways = [F.substring("ends", 1, 1).alias("sdir"), F.substring("ends", 2, 1).alias("ddir"), F.col("what").alias("dst")]
        return Graph(
            of("node").select("node_id", F.col("what").alias("seq"), F.col("n").alias("cov")), of("edge").select(F.col("node_id").alias("src"), *ways),
            of("thread").select("node_id", *ways, "read"), of("start").select("node_id", "read", (F.col("ends") == "r").alias("rc"), F.col("n").cast("int").alias("off")),
        )
    # the id and kind first, then a part from each mark to the next
    line = spark.read.text(path).select(F.split("value", r"\t(?=\*[a-z0-9])").alias("w")).select(F.split(F.element_at("w", 1), "\t").alias("id"), "w")
    kind = F.when(F.try_element_at("id", F.lit(2)) == "N", F.element_at("id", 1)).otherwise(F.raise_error(F.lit("not a node message")))

    def field(mark: str) -> Column:
        """Words from a mark to the next one."""
        part = F.try_element_at(F.filter("w", lambda x: x.startswith(f"{mark}\t")), F.lit(1))
        return F.when(part.isNotNull(), F.split(F.substr(part, F.lit(len(mark) + 2)), "\t")).otherwise(F.array().cast("array<string>"))

    x = line.select(kind.alias("packed"), *[field(f"*{m}").alias(n) for m, n in (("s", "s"), ("v", "v"), *zip(TYPES, TYPES, strict=True), ("5", "r5"), ("d", "d"))])
    node = unpack_name(F.col("packed")).alias("node_id")
    nodes = x.select(node, unpack(F.element_at("s", 1)).alias("seq"), F.element_at("v", 1).cast("double").alias("cov"))
    kinds = lambda t: F.transform(t, lambda to: F.struct(F.lit(t[0]).alias("sdir"), F.lit(t[1]).alias("ddir"), to.alias("dst")))
    ends = F.concat(*map(kinds, TYPES))
    edges = x.select(node, F.explode(ends).alias("e")).select(F.col("node_id").alias("src"), "e.sdir", "e.ddir", unpack_name(F.col("e.dst")).alias("dst"))
    # a read's name may hold what parts the words before it
    d = x.select(node, F.explode("d").alias("t")).select("node_id", F.split("t", ":", 3).alias("p"))
    threads = d.select("node_id", F.substring(F.col("p")[0], 1, 1).alias("sdir"), F.substring(F.col("p")[0], 2, 1).alias("ddir"), unpack_name(F.col("p")[1]).alias("dst"), F.col("p")[2].alias("read"))
    r = x.select(node, F.explode("r5").alias("p"))
    starts = r.select("node_id", F.regexp_extract("p", "^~?(.*):[0-9]+$", 1).alias("read"), F.col("p").startswith("~").alias("rc"), F.regexp_extract("p", ":([0-9]+)$", 1).cast("int").alias("off"))
    return Graph(nodes, edges, threads, starts)
