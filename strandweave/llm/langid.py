"""Language identification in two steps: the family, then the language within it.

One-versus-rest linear machines choose the family; inside a family, a linear support
vector machine for each pair of its languages votes with a calibrated probability.  A
language's probability is its family's times the share of its pairs' votes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import LETTERS, features
from .cluster import Workspace, trimmed
from .linear import fit_platt, fit_svm, sigmoid

BITS = 12
#: Bounds of the training sample: documents in all, and of one language.
SAMPLE, SAMPLE_EACH = 6000, 1200
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl ht it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg mi ms su tl",
    "bantu": "rw sn sw xh zu",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY_OF.get(code, f"only {lang}")


@dataclass
class Model:
    """Weights as one matrix: family machines first, then the pairs'."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    offsets: np.ndarray | None = None
    slopes: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        p = sigmoid(x @ self.weights * self.slopes + self.offsets) if self.weights is not None else np.zeros((len(x), 0))
        family = p[:, : len(names)] if len(names) > 1 else np.ones((len(x), 1))
        family = np.maximum(family, 1e-9)
        family = family / family.sum(axis=1, keepdims=True)
        column = {pair: (len(names) if len(names) > 1 else 0) + k for k, pair in enumerate(self.pairs)}
        best = np.full(len(x), -1.0)
        out = np.array([UNKNOWN] * len(x), object)
        chosen = family.argmax(axis=1)
        for f, name in enumerate(names):
            rows = np.flatnonzero(chosen == f)
            langs = self.families[name]
            for lang in langs:
                if len(langs) == 1:
                    share = np.ones(len(rows))
                else:
                    votes = [p[rows, column[a, b]] if lang == a else 1 - p[rows, column[a, b]] for a, b in self.pairs if lang in (a, b)]
                    share = sum(votes) / (len(langs) * (len(langs) - 1) / 2)
                score = family[rows, f] * share
                better = score > best[rows]
                best[rows[better]] = score[better]
                out[rows[better]] = lang
        return out.tolist(), np.clip(best, 0.0, 1.0)


def train(x: np.ndarray, langs: np.ndarray) -> Model:
    """Fits all machines on rows sorted by language; no machine copies rows."""
    by: dict[str, list[str]] = {}
    rows: dict[str, slice] = {}
    for lang in sorted(set(langs.tolist())):
        by.setdefault(family_of(lang), []).append(lang)
        rows[lang] = slice(int(np.searchsorted(langs, lang)), int(np.searchsorted(langs, lang, "right")))
    model = Model(by)
    if not by:
        return model
    names = sorted(by)
    columns = []

    def machine(some: list[str], positive: set[str]) -> None:
        parts = [x[rows[lang]] for lang in some]
        y = np.concatenate([np.full(len(p), 1.0 if lang in positive else -1.0, np.float32) for p, lang in zip(parts, some, strict=True)])
        weight = np.where(y > 0, 1.0 / max(1, (y > 0).sum()), 1.0 / max(1, (y < 0).sum()))
        w, b = fit_svm(parts, y, weight)
        slope, shift = fit_platt(np.concatenate([p @ w + b for p in parts]).astype(np.float64), (y > 0).astype(float))
        columns.append((w, slope, slope * b + shift))

    if len(names) > 1:
        for name in names:
            machine(list(rows), set(by[name]))
    for name in names:
        model.pairs += [(a, b) for i, a in enumerate(by[name]) for b in by[name][i + 1 :]]
    for a, b in model.pairs:
        machine([a, b], {a})
    if columns:
        model.weights = np.stack([c[0] for c in columns], axis=1).astype(np.float32)
        model.slopes = np.array([c[1] for c in columns])
        model.offsets = np.array([c[2] for c in columns])
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, x in features(batch.column("text"), BITS, LETTERS):
            body = [r.tobytes() for r in x.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(first, len(x)), pa.array(body, pa.binary())], names=["lang", "x"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in zip(batch.column("lang").to_pylist(), batch.column("x").to_pylist(), strict=True)]
    rows.sort()  # the fit must not depend on the order of arrival
    x = np.empty((len(rows), 1 << BITS), np.float32)
    for i, (_, body) in enumerate(rows):
        x[i] = np.frombuffer(body, np.float16)
    model = train(x, np.array([lang for lang, _ in rows], object))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit(docs: DataFrame, sample: int = SAMPLE, each: int = SAMPLE_EACH) -> Model:
    """Learns from docs(doc_id, text, lang); rows with a null text or lang teach nothing.

    A sample of at most ``sample`` documents (about ``each`` a language, at most), drawn
    by a hash of the id and the text, is fitted in one task; only the weights come to the driver.
    """
    Workspace(docs.sparkSession, "langid")  # ships the package
    known = docs.where("text is not null and lang is not null").select(F.col("doc_id"), "text", "lang")
    counts = dict(known.groupBy("lang").count().collect())  # one row a language
    if not counts:
        return Model({})
    quota = 0.9 * max(1, min(each, sample // len(counts)))  # so that chance hardly ever goes beyond the bound
    draw = F.pmod(F.xxhash64(F.col("doc_id"), "text", F.lit(11)), F.lit(1_000_000)) / 1e6
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, quota / n))])
    chosen = known.where(draw < share[F.col("lang")]).select("text", "lang")
    rows = chosen.mapInArrow(trimmed(_sampled), "lang string, x binary").limit(sample)
    found = rows.mapInArrow(trimmed(_train), "model binary").first()
    return pickle.loads(found["model"]) if found else Model({})


def _languages(model: Model, text: pa.Array, x: np.ndarray, first: int) -> tuple[list[str], np.ndarray]:
    lang, score = model.predict(x)
    for i, t in enumerate(text.slice(first, len(x)).to_pylist()):
        if not model.families or t is None or not any(map(str.isalpha, t)):
            lang[i], score[i] = UNKNOWN, 0.0
    return lang, score


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in features(batch.column("text"), BITS, LETTERS):
                lang, score = _languages(model, batch.column("text"), x, first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(x)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text; only the text is looked at.

    A null text, or one without any letter, is ``und`` with score 0, as is every text if
    the model has learned nothing.  Very long texts are read whole.  Repeated rows are
    predicted each; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(trimmed(_predict(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language has a score of ``least`` or more; ``und`` never has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in features(batch.column("text"), BITS, LETTERS):
                lang, score = _languages(model, batch.column("text"), x, first)
                keep = (score >= least) & (np.array(lang, object) != UNKNOWN)
                yield batch.slice(first, len(x)).filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)
