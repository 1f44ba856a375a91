"""Quality scores by co-training two views of a document.

The text view sees hashed byte trigrams and how repetitive they are; the metadata view sees source, language and
declared length, never the text.  Both start from the labelled sample.  In each round
each view labels those of all unlabelled documents of which it is surest, in the
proportion of the classes, and hands them to the other view's training set.  In the end
each view is calibrated on the labelled sample by cross-fitting, and the evidence of
both is added: logit = prior + (text - prior) + weight * (metadata - prior), the weights fitted on the
cross-fitted logits.  All documents are scored.

A round is one task that fits the views on the samples, and one pass over all documents
that finds the surest; only weights and the picked ids come to the driver.  Three further
models, each without a third of the labelled sample, go along in the same tasks and passes.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytegrams import features
from .bytewords import text_bytes
from .cluster import Workspace, trimmed
from .linear import fit_logistic, sigmoid

BITS = 11
EXTRA, META = 4, 128
#: Bound of the labelled sample: documents of each class.
LABELLED_EACH = 2500
#: Rounds, and documents that each view labels in a round.
ROUNDS, PER_ROUND = 4, 200
#: Parts of the labelled sample; model ``f`` is fitted without part ``f``, the last one on all.
FOLDS = 3
#: Weight of the penalty on each view's coefficients.
RIDGE_TEXT, RIDGE_META = 1e-6, 1e-3


def text_features(column):
    """(first row, matrix): trigrams, then their entropy, concentration, share of distinct ones, and the text's order of magnitude."""
    _, off = text_bytes(column)
    for first, x in features(column, BITS):
        p = x * x  # the trigrams' shares
        total = np.maximum(np.diff(off[first : first + len(x) + 1]) - 2, 0)
        entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1)
        distinct = (x > 0).sum(axis=1) / np.maximum(np.minimum(total, 1 << BITS), 1)
        extra = np.stack([entropy / 3, 3 * np.sqrt((p * p).sum(axis=1)), distinct, np.log1p(total) / 4], axis=1)
        yield first, np.concatenate([x, extra.astype(np.float32)], axis=1)


def metadata_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed one-hot source and language, and the declared length's order of magnitude; nulls are values of their own."""
    x = np.zeros((len(source), META), np.float32)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        x[i, zlib.crc32(f"s{s}".encode()) % 64] += 1
        x[i, 64 + zlib.crc32(f"l{g}".encode()) % 32] += 1
        x[i, 96 + (31 if n is None or n < 0 else min(30, int(2 * np.log2(1 + n))))] += 1
    return x / np.float32(np.sqrt(3))


@dataclass
class View:
    w: np.ndarray
    b: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.w + self.b).astype(np.float64)


@dataclass
class Model:
    text: View
    meta: View
    prior: float
    mix: tuple[float, float, float]  # weights of both views' evidence, and an offset

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text.margin(text), self.meta.margin(meta)
        a, b, c = self.mix
        return sigmoid(t), sigmoid(m), sigmoid(self.prior + a * (t - self.prior) + b * (m - self.prior) + c)


@dataclass
class Sample:
    """Labelled rows, sorted by fold, and rows that a view has labelled."""

    views: tuple[np.ndarray, np.ndarray]
    y: np.ndarray
    fold: np.ndarray
    prior: float
    extra: tuple[np.ndarray, np.ndarray]

    @property
    def weight(self) -> np.ndarray:
        """The sample is balanced; the weights bring its classes back to their share."""
        good = self.y > 0.5
        return np.where(good, self.prior / max(1, good.sum()), (1 - self.prior) / max(1, (~good).sum())) * len(self.y)

    def fit(self, run: int, picked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[View, View]:
        """Both views of a model; ``picked``: for each view, the rows of ``extra`` that the other one has labelled, and how."""
        at = np.searchsorted(self.fold, np.arange(FOLDS + 1))
        some = [slice(at[f], at[f + 1]) for f in range(FOLDS) if f != run]
        out = []
        for x, extra, ridge, (rows, label) in zip(self.views, self.extra, (RIDGE_TEXT, RIDGE_META), picked, strict=True):
            y = np.concatenate([*(self.y[s] for s in some), label]).astype(np.float32)
            w = np.concatenate([*(self.weight[s] for s in some), np.ones(len(rows))])
            out.append(View(*fit_logistic([*(x[s] for s in some), extra[rows]], y, w, ridge)))
        return out[0], out[1]

    def combine(self, models: list[tuple[View, View]]) -> Model:
        """The last model, with weights of the evidence fitted on the logits of the others for the rows they have not seen."""
        base = float(np.log(self.prior / (1 - self.prior)))
        evidence = np.zeros((len(self.y), 2), np.float64)
        for f, (t, m) in enumerate(models[:FOLDS]):
            out = self.fold == f
            if out.any() and len(set(self.y[~out].tolist())) == 2:
                evidence[out] = np.stack([t.margin(self.views[0][out]) - base, m.margin(self.views[1][out]) - base], axis=1)
        scale = np.maximum(np.abs(evidence).max(axis=0), 1.0)
        weight, w = self.weight, np.zeros(3)
        z = np.concatenate([evidence / scale, np.ones((len(self.y), 1))], axis=1)
        for _ in range(400):  # logistic regression with the prior's logit as a fixed offset
            p = sigmoid(base + z @ w)
            gradient = z.T @ (weight * (p - self.y)) / len(self.y) + 1e-4 * w
            hessian = (z * (weight * p * (1 - p))[:, None]).T @ z / len(self.y) + 1e-3 * np.eye(3)
            step = np.linalg.solve(hessian, gradient)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        mix = (max(0.0, float(w[0] / scale[0])), max(0.0, float(w[1] / scale[1])), float(w[2]))
        return Model(*models[-1], base, mix)


def arranged(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows that is sorted by fold, and the folds; every fold has both classes, if they have that many rows."""
    rank = np.where(y > 0.5, np.cumsum(y > 0.5) / max(1, (y > 0.5).sum()), np.cumsum(y <= 0.5) / max(1, (y <= 0.5).sum()))
    order = np.argsort(rank, kind="stable")
    fold = np.arange(len(y)) % FOLDS
    return order[np.argsort(fold, kind="stable")], np.sort(fold)


class Picks:
    """What each view has labelled for the other, by model: (document, label), each document once a model."""

    def __init__(self):
        self.of: list[list[dict[int, float]]] = [[{}, {}] for _ in range(FOLDS + 1)]

    def add(self, run: int, view: int, label: float, docs: list[int]) -> None:
        known, other = self.of[run]
        for d in docs:
            if d not in known and d not in other:
                self.of[run][1 - view][d] = label

    def rows(self, run: int, place: dict[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view, rows of the documents it is taught, in order of their ids, and their labels."""
        found = [sorted((d, label) for d, label in taught.items() if d in place) for taught in self.of[run]]
        return [(np.array([place[d] for d, _ in f], np.int64), np.array([label for _, label in f], np.float64)) for f in found]

    def docs(self, run: int) -> np.ndarray:
        return np.array(sorted({*self.of[run][0], *self.of[run][1]}), np.int64)


def shares(prior: float, n: int) -> tuple[int, int]:
    """How many good and bad documents a view labels in a round."""
    good = int(round(n * prior))
    return n - good, good


def surest(margin: np.ndarray, ids: np.ndarray, n: int, label: int) -> np.ndarray:
    """Rows of the n documents of which a view is surest, beyond a probability of 0.9; ties go to the smaller id, each id counts once."""
    sure = margin if label else -margin
    rows = np.flatnonzero(sure > np.log(9.0))
    rows = rows[np.lexsort((ids[rows], -sure[rows]))]
    _, first = np.unique(ids[rows], return_index=True)
    return rows[np.sort(first)[:n]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, prior: float, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """All in memory; y is 0 or 1 for the labelled rows, ``prior`` the share of 1 in all labelled documents."""
    share = float(np.clip(prior, 0.01, 0.99))
    order, fold = arranged(y)
    s = Sample((text[order], meta[order]), y[order], fold, share, (pool_text, pool_meta))
    ids, picks = np.arange(len(pool_text)), Picks()
    place = {i: i for i in range(len(ids))}
    for r in range(rounds + 1):
        models = [s.fit(run, picks.rows(run, place)) for run in range(FOLDS + 1)]
        if r == rounds:
            break
        for run, views in enumerate(models):
            free = np.flatnonzero(~np.isin(ids, picks.docs(run)))
            for k, (view, x) in enumerate(zip(views, s.extra, strict=True)):
                for label, n in enumerate(shares(share, per_round)):
                    picks.add(run, k, float(label), free[surest(view.margin(x[free]), free, n, label)].tolist())
    return s.combine(models)


_SAMPLED = "doc_id long, x binary, source string, lang string, n_chars long"
_CANDIDATE = "run int, view int, label int, doc_id long, sure double"


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, x in text_features(batch.column("text")):
            body = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
            part = batch.slice(first, len(x))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), body, part.column("source"), part.column("lang"), part.column("n_chars")], names=[f.split(" ")[0] for f in _SAMPLED.split(", ")])


def _fit(prior: float, picks: Picks, last: bool):
    """One task: rows (doc_id, y, features) of the labelled sample, and of picked documents with a null y, make all models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[dict[int, tuple]] = [{}, {}]
        for batch in batches:
            for r in batch.to_pylist():
                got[r["y"] is None][r["doc_id"]] = (r["y"], r["x"], r["source"], r["lang"], r["n_chars"])
        ids = [np.array(sorted(g), np.int64) for g in got]
        y = np.array([got[0][i][0] for i in ids[0].tolist()], np.float64)
        if len(set(y.tolist())) < 2:
            return
        order, fold = arranged(y)
        ids[0] = ids[0][order]

        def matrices(table: dict, keys: list) -> tuple[np.ndarray, np.ndarray]:
            text = np.empty((len(keys), (1 << BITS) + EXTRA), np.float32)
            for i, key in enumerate(keys):
                text[i] = np.frombuffer(table[key][1], np.float16)
            return text, metadata_features(*([table[i][c] for i in keys] for c in (2, 3, 4)))

        s = Sample(matrices(got[0], ids[0].tolist()), y[order], fold, prior, matrices(got[1], ids[1].tolist()))
        place = {d: i for i, d in enumerate(ids[1].tolist())}
        models = [s.fit(m, picks.rows(m, place)) for m in range(FOLDS + 1)]
        body = pickle.dumps((s.combine(models) if last else models, ids[0]))
        yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["model"])

    return run


def _candidates(models: list[tuple[View, View]], sampled: np.ndarray, picks: Picks, numbers: tuple[int, int]):
    """The documents of a task of which each view of each model is surest, but for the labelled sample and those picked before."""
    known = [np.union1d(sampled, picks.docs(run)) for run in range(len(models))]
    weights = [np.stack([m[k].w for m in models], axis=1) for k in (0, 1)]
    offsets = [np.array([m[k].b for m in models]) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for first, x in text_features(batch.column("text")):
                part = batch.slice(first, len(x))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                meta = metadata_features(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
                # half precision, as the sample has it, so that a document scores alike wherever it is
                margins = [(v @ w + b).astype(np.float64) for v, w, b in zip((x.astype(np.float16).astype(np.float32), meta), weights, offsets, strict=True)]
                for m in range(len(models)):
                    free = ~np.isin(ids, known[m])
                    for view in (0, 1):
                        for label, n in enumerate(numbers):
                            old = best.get((m, view, label), (np.zeros(0), np.zeros(0, np.int64)))
                            margin, docs = np.concatenate([old[0], margins[view][free, m]]), np.concatenate([old[1], ids[free]])
                            rows = surest(margin, docs, n, label)
                            best[m, view, label] = margin[rows], docs[rows]
        for (m, view, label), (margin, docs) in best.items():
            cells = [*(pa.array(np.full(len(docs), v), pa.int32()) for v in (m, view, label)), pa.array(docs, pa.int64()), pa.array(np.abs(margin), pa.float64())]
            yield pa.RecordBatch.from_arrays(cells, names=[f.split(" ")[0] for f in _CANDIDATE.split(", ")])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def fit(docs: DataFrame, labels: DataFrame, each: int = LABELLED_EACH, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model | None:
    """Co-trains on a bounded sample of labelled documents and on all others: docs(doc_id, text, source, lang, n_chars), labels(doc_id, quality).

    At most ``each`` labelled documents of a class are drawn; documents outside the sample
    count as unlabelled, and every one of them may be picked in any of ``rounds`` rounds,
    ``per_round`` by a view.  A document with several labels counts by their mean, at
    least 0.5 being good; null labels count for nothing; rows of one doc_id count as one,
    those without a doc_id are neither sampled nor picked.  None, if the labels of the
    documents do not have both classes.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "quality")
    rows = _rows(docs).where("doc_id is not null")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = work.put(known.withColumn("doc_id", F.col("doc_id").cast("long")), "labels")
    counts = dict(known.groupBy("y").count().collect())  # two rows
    if len(counts) < 2:
        return None
    prior = float(np.clip(counts[1] / (counts[0] + counts[1]), 0.01, 0.99))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(10_000_000)) / 1e7
    share = {y: min(1.0, 0.95 * each / n) for y, n in counts.items()}  # so that chance hardly ever goes beyond the bound
    chosen = known.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).limit(2 * each)  # bounded, so it may be broadcast

    def features_of(some: DataFrame, name: str) -> DataFrame:
        """Stored features of the documents of ``some``(doc_id, y), a bounded table; repeated rows meet in a partial minimum."""
        found = rows.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(trimmed(_sampled), _SAMPLED)
        one = found.groupBy("doc_id").agg(F.min(F.struct("x", "source", "lang", "n_chars")).alias("r"))
        return work.put(one.join(F.broadcast(some), "doc_id").select("doc_id", "y", "r.*"), name)

    have, picks = features_of(chosen, "sample"), Picks()
    for r in range(rounds + 1):
        # the samples are bounded: one task fits
        fitted = have.repartition(1).mapInArrow(trimmed(_fit(prior, picks, r == rounds)), "model binary").first()
        if fitted is None:
            return None
        models, sampled = pickle.loads(fitted["model"])
        if r == rounds:
            return models
        numbers = shares(prior, per_round)
        found = rows.mapInArrow(trimmed(_candidates(models, sampled, picks, numbers)), _CANDIDATE)
        found = found.groupBy("run", "view", "label", "doc_id").agg(F.max("sure").alias("sure"))
        order = W.partitionBy("run", "view", "label").orderBy(F.desc("sure"), "doc_id")
        # the plain limit is kept by every task before the groups meet
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(numbers)).where(F.col("rank") <= F.when(F.col("label") == 1, numbers[1]).otherwise(numbers[0]))
        surest_of: dict[tuple, list] = {}
        before = {d for run in range(FOLDS + 1) for d in picks.docs(run).tolist()}
        for c in found.orderBy("run", "view", "label", "rank").collect():  # a bounded number
            surest_of.setdefault((c["run"], c["view"], c["label"]), []).append(c["doc_id"])
        for (run, view, label), ids in surest_of.items():
            picks.add(run, view, float(label), ids)
        fresh = {d for run in range(FOLDS + 1) for d in picks.docs(run).tolist()} - before
        if fresh:
            some = spark.createDataFrame([(d, None) for d in sorted(fresh)], "doc_id long, y int")
            have = have.union(features_of(some, f"picked{r}"))


def _scored(model: Model, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    for first, x in text_features(batch.column("text")):
        part = batch.slice(first, len(x))
        meta = metadata_features(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
        yield part, model.score(x, meta)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_metadata, score, keep) of every row; ``keep`` is score >= threshold.

    Null or empty texts are scored by an empty text view; very long texts are read whole;
    null metadata are values of their own.  Without a model (no labels of both classes)
    everything scores 0.5 and is kept.  Repeated rows are scored each; other columns are
    ignored; an empty table gives no rows.
    """
    Workspace(docs.sparkSession, "quality")
    schema = "doc_id long, p_text double, p_metadata double, score double, keep boolean"
    if model is None:
        half = F.lit(0.5)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), half.alias("p_text"), half.alias("p_metadata"), half.alias("score"), F.lit(True).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (t, m, both) in _scored(model, batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(t), pa.array(m), pa.array(both), pa.array(both >= threshold)], names=["doc_id", "p_text", "p_metadata", "score", "keep"])

    return _rows(docs).mapInArrow(trimmed(run), schema)


def good(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that ``score`` would keep; nothing is shuffled."""
    Workspace(docs.sparkSession, "quality")
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (_, _, both) in _scored(model, batch):
                yield part.filter(pa.array(both >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
