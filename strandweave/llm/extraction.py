"""Main text of web pages by wrappers, inferred for each host from all its pages.

A task merges the pages of each host as it reads them; its wrappers, a row a host, are
merged by host over groups of tasks, in rounds.  So no page is moved for the inference,
and a host of any size is a few small rows a task.  Pages then meet the decisions of their
host's wrapper; hosts with many pages are spread over as many parts as their share asks for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markup
from .cluster import Workspace, shuffle_partitions, trimmed
from .urlblock import host_of

#: Hosts held by a task before its wrappers are written; a host may come in several rows.
HELD = 5000
#: Tasks, or groups of tasks, whose wrappers of a host one step merges.
FAN = 256
#: A host with more than one page in so many is spread; there are at most as many such hosts.
SHARE = 1000

WRAPPERS = "part long, host string, pages long, wrapper string"


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held = TaskContext.get().partitionId(), {}

    def rows() -> pa.RecordBatch:
        nodes = list(held.items())
        held.clear()
        columns = [pa.array([part] * len(nodes), pa.int64()), pa.array([h for h, _ in nodes], pa.string()), pa.array([w.n for _, w in nodes], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([json.dumps(markup.dump(w)) for _, w in nodes], pa.string())], names=["part", "host", "pages", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            own = markup.wrapper_of(markup.parse(page.as_py() or ""))
            held[host] = markup.merged(held[host], own) if host in held else own
            if len(held) > HELD:
                yield rows()
    if held:
        yield rows()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges neighbouring rows of one host and part."""
    now, wrapper = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[1]], pa.int64()), pa.array([now[0]], pa.string()), pa.array([wrapper.n], pa.int64()), pa.array([json.dumps(markup.dump(wrapper))], pa.string())], names=["part", "host", "pages", "wrapper"]
        )

    for batch in batches:
        for key, packed in zip(zip(batch.column("host").to_pylist(), batch.column("part").to_pylist(), strict=True), batch.column("wrapper"), strict=True):
            other = markup.load(json.loads(packed.as_py()))
            if key == now:
                wrapper = markup.merged(wrapper, other)
                continue
            if now is not None:
                yield row()
            now, wrapper = key, other
    if now is not None:
        yield row()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans = [json.dumps(markup.plan(markup.load(json.loads(w)))) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pages"), pa.array(plans, pa.string())], names=["host", "pages", "plan"])


def wrappers(pages: DataFrame, work: Workspace) -> DataFrame:
    """(host, pages, plan): the decisions of each host's wrapper over all its pages(url, html)."""
    width = shuffle_partitions(pages.sparkSession)
    own = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    now = work.put(own.mapInArrow(trimmed(_infer), WRAPPERS), "wrappers0")
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    for k in range(1, 65):
        dealt = now.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).repartition(width, "host", "part").sortWithinPartitions("host", "part")
        now = work.put(dealt.mapInArrow(trimmed(_merge), WRAPPERS), f"wrappers{k}")
        parts = -(-parts // FAN)
        if parts == 1:
            break
    return work.put(now.mapInArrow(trimmed(_decide), "host string, pages long, plan string"), "plans")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = lru_cache(4096)(json.loads)
    for batch in batches:
        found = [markup.article(h.as_py() or "", known(p) if p is not None else None) for h, p in zip(batch.column("html"), batch.column("plan").to_pylist(), strict=True)]
        size = pa.array(map(len, found), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), size], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    ``text`` has the article's blocks in page order, one line each, white space inside a
    block as one space, character references decoded; empty if there is none.  The html is
    read whole; a null one counts as empty.  Rows with a null url, or without ``://``, share
    the host ''.  Repeated rows are read each, other columns are ignored, an empty table
    gives no rows.  A page without the region that its host's wrapper found goes by its own
    structure.
    """
    work = Workspace(pages.sparkSession, "extraction")
    plans = wrappers(pages, work)
    total = plans.agg(F.sum("pages")).first()[0] or 0
    share = F.ceil(F.col("pages") * SHARE / F.lit(max(total, 1))).cast("int")
    wide = F.broadcast(plans.where(F.col("pages") * SHARE > total).select("host", share.alias("salts")))  # at most SHARE rows
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host")).join(wide, "host", "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    salts = F.when(F.col("pages") * SHARE > total, share).otherwise(1)
    dealt = plans.select("host", "plan", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = rows.join(dealt, ["host", "salt"], "left").select("page_id", "url", "html", "plan")
    kind = pages.schema["page_id"].dataType.simpleString()
    return met.mapInArrow(trimmed(_extract), f"page_id {kind}, url string, text string, n_chars long")
