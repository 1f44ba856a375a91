"""Benchmark decontamination: a BM25 index of test items, queried by every training document.

The collection is the test items; each is a question and an answer (its last sentence).
A query is a whole document, of which every term counts once, since the shingles of an
item may lie anywhere in it.  All items above the threshold are retrieved: the score that
the item reaches by itself, less the weightiest terms that could be missing from a
document with enough of its shingles.

The index holds postings by term, in blocks of items, with the largest impact of every
block.  Block-max WAND without a top k, for many documents at once: a document's terms
whose largest impacts together stay below every threshold are left out of the walk; the
block maxima of the others are added up by block; a block has a pivot, and is looked at,
only if its sum and the share of the terms left out reach its lowest threshold; and only
there the postings of all terms are read.

A retrieved item is verified on word shingles of the whole document: the shares of the
question's and of the answer's shingles found there are reported, and the item counts as
leaked when ``num/den`` of all its shingles are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import NOT_ALNUM, pieces, shingles, text_bytes, words
from .cluster import Workspace, trimmed

#: Items of a block.
BLOCK = 8
#: Text bytes of the items that one pass over the documents may carry; more items make more passes.
PASS_BYTES = 32 << 20
#: Postings that are gathered at once, but for a document that alone has more.
GATHERED = 1 << 21
K1, B = 1.2, 0.75


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence, if there are several."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (" ".join(parts), "")


def item_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of items, where each item's begin, and how many words its question has."""
    halves = [split_item(t) for t in texts]
    raw, off = text_bytes(pa.array([f"{q} {a}" for q, a in halves], pa.large_string()))
    h, at = words(raw, off, NOT_ALNUM)
    raw, off = text_bytes(pa.array([q for q, _ in halves], pa.large_string()))
    return h, at, np.diff(words(raw, off, NOT_ALNUM)[1])


@dataclass
class Collection:
    """Statistics over all items, whichever pass they fall into."""

    items: int
    mean_length: float
    terms: np.ndarray  # sorted hashes, at least those of the pass
    frequency: np.ndarray  # items a term is in


def collection(h: np.ndarray, at: np.ndarray) -> Collection:
    n = len(at) - 1
    vocab, term = np.unique(h, return_inverse=True)
    pair = np.unique(term * max(n, 1) + np.repeat(np.arange(n), np.diff(at)))
    return Collection(n, len(h) / max(n, 1), vocab, np.bincount(pair // max(n, 1), minlength=len(vocab)))


@dataclass
class Index:
    ids: list[int]
    vocab: np.ndarray  # sorted term hashes
    entry: np.ndarray  # first block entry of each term, and their number
    block_key: np.ndarray  # term * blocks + block of each entry, sorted
    block_max: np.ndarray  # largest impact of each entry
    posting: np.ndarray  # first posting of each entry, and their number
    item: np.ndarray  # items of postings, ascending within a term
    impact: np.ndarray
    term_max: np.ndarray
    theta: np.ndarray  # by item
    block_theta: np.ndarray
    own: np.ndarray  # an item's own score
    sets: list[tuple[np.ndarray, np.ndarray]]  # an item's shingles, and which of them lie in the question alone
    widths: list[int]  # words a shingle of the item has


def build(ids: list[int], texts: list[str], k: int, num: int = 75, den: int = 100, whole: Collection | None = None) -> Index:
    h, at, q_words = item_words(texts)
    whole = whole or collection(h, at)
    # items of like length together make blocks, so that a block's threshold is no lower than need be
    order = np.argsort(np.diff(at), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = len(ids)
    vocab, term = np.unique(h, return_inverse=True)
    pair, tf = np.unique(term * n + rank[np.repeat(np.arange(n), np.diff(at))], return_counts=True)
    term, item = pair // n, pair % n
    df = whole.frequency[np.searchsorted(whole.terms, vocab)]
    idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
    length = np.diff(at)[order]
    impact = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(whole.mean_length, 1e-9)))).astype(np.float32)
    blocks = -(-n // BLOCK)
    key = term * blocks + item // BLOCK
    block_key, first = np.unique(key, return_index=True)
    sets, widths = [], []
    for i in order.tolist():
        w = h[at[i] : at[i + 1]]
        s, _ = shingles(w, np.array([0, len(w)]), k)
        in_question = max(0, int(q_words[i]) - k + 1) if len(w) >= k else int(len(w) > 0 and q_words[i] == len(w))
        found, where = np.unique(s, return_index=True)
        sets.append((found, where < in_question))
        widths.append(min(k, len(w)))
    # if any shingle is there, every missing one can take one more term away, not more
    own = np.bincount(item, impact, minlength=n)
    weightiest = np.lexsort((-impact, item))
    begin = np.searchsorted(item[weightiest], np.arange(n + 1))
    place = np.arange(len(item)) - begin[item[weightiest]]
    missing = np.array([len(found) - -(-num * len(found) // den) for found, _ in sets])
    falls = place < missing[item[weightiest]]
    lost = np.bincount(item[weightiest][falls], impact[weightiest][falls], minlength=n)
    theta = np.maximum(own * (1 - 1e-4) - lost, 0)
    return Index(
        [ids[i] for i in order.tolist()], vocab, np.searchsorted(block_key, np.arange(len(vocab) + 1) * blocks), block_key, np.maximum.reduceat(impact, first),
        np.append(first, len(item)), item, impact, np.maximum.reduceat(impact, np.searchsorted(term, np.arange(len(vocab)))), theta,
        np.minimum.reduceat(theta, np.arange(0, n, BLOCK)), own, sets, widths,
    )


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each first to before its last, and which range each is of."""
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner], owner


def cut(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows in a line as parts of at most ``most`` in cost; a dearer one is a part."""
    total, a = np.concatenate([[0], np.cumsum(cost)]), 0
    while a < len(cost):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b


def search(index: Index, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(text, item's place, score) of every text and item above the item's threshold, by text."""
    if len(h) == 0 or len(index.vocab) == 0:
        return
    place = np.searchsorted(index.vocab, h)
    place[place == len(index.vocab)] = 0
    here = np.flatnonzero(index.vocab[place] == h)
    n, blocks, least = len(at) - 1, len(index.block_theta), index.theta.min()
    pair = np.unique(np.repeat(np.arange(n), np.diff(at))[here] * len(index.vocab) + place[here])  # a term counts once
    text, term = pair // len(index.vocab), pair % len(index.vocab)
    bound = np.bincount(text, index.term_max[term], minlength=n)
    keep = ((bound >= least) & (bound > 0))[text]
    text, term = text[keep], term[keep]
    if len(text) == 0:
        return
    # weak terms first: as long as they together stay below every threshold, they bring no item in
    order = np.lexsort((index.term_max[term], text))
    text, term = text[order], term[order]
    total = np.cumsum(index.term_max[term].astype(np.float64))
    begin = np.searchsorted(text, np.arange(n + 1))
    before = np.append(0, total)[begin[:-1]]
    weak = total - before[text] < least * (1 - 1e-6)
    spare = np.bincount(text, np.where(weak, index.term_max[term], 0), minlength=n)
    alive = np.flatnonzero(np.diff(begin))
    entries = np.bincount(text, np.where(weak, 0, index.entry[term + 1] - index.entry[term]), minlength=n)[alive]
    for a, b in cut(entries + blocks, GATHERED):
        some = alive[a:b]
        rows = slice(begin[some[0]], begin[some[-1] + 1])
        mine, terms, strong = np.searchsorted(some, text[rows]), term[rows], ~weak[rows]
        e, owner = ranges(index.entry[terms[strong]], index.entry[terms[strong] + 1])
        key = mine[strong][owner] * blocks + index.block_key[e] % blocks
        sums = np.bincount(key, index.block_max[e], minlength=len(some) * blocks)
        limit = index.block_theta * (1 - 1e-6)
        pivot = np.flatnonzero((sums > 0) & (sums.reshape(len(some), blocks) + spare[some][:, None] >= limit).reshape(-1))
        own = np.searchsorted(mine, np.arange(len(some) + 1))
        for c, d in cut(np.diff(own)[pivot // blocks], GATHERED):
            looked = pivot[c:d]
            t, which = ranges(own[looked // blocks], own[looked // blocks + 1])
            wanted = terms[t] * blocks + looked[which] % blocks
            e = np.minimum(np.searchsorted(index.block_key, wanted), len(index.block_key) - 1)
            there = index.block_key[e] == wanted
            p, owner = ranges(index.posting[e[there]], index.posting[e[there] + 1])
            scores = np.bincount(which[there][owner] * BLOCK + index.item[p] % BLOCK, index.impact[p], minlength=len(looked) * BLOCK)
            hit = np.flatnonzero(scores > 0)
            item = looked[hit // BLOCK] % blocks * BLOCK + hit % BLOCK
            for j in np.flatnonzero(scores[hit] >= index.theta[item] * (1 - 1e-6)).tolist():
                yield int(some[looked[hit[j] // BLOCK] // blocks]), int(item[j]), float(scores[hit[j]])


FOUND = "doc_id long, item_id long, bm25 double, own_bm25 double, question_overlap double, answer_overlap double, shared_shingles long, item_shingles long"


def _leaks(index: Index, column: pa.Array, k: int, num: int, den: int) -> Iterator[tuple]:
    """(row, item's place, score, hits, question's part) of every leaked item of every text, text by text."""
    for first, raw, off in pieces(column, 1 << 20):
        h, at = words(raw, off, NOT_ALNUM)
        now, own = -1, {}
        for text, item, score in search(index, h, at):
            if text != now:
                now, own = text, {}
            width = index.widths[item]
            if width not in own:
                own[width] = _runs(h[at[text] : at[text + 1]], width, k)
            mine, asks = index.sets[item]
            hit = _among(mine, own[width])
            if len(mine) and den * int(hit.sum()) >= num * len(mine):
                yield first + text, item, score, hit, asks


def _match(index: Index, k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column("doc_id"), []
            for row, item, score, hit, asks in _leaks(index, batch.column("text"), k, num, den):
                out.append((keys[row].as_py(), index.ids[item], score, float(index.own[item]), _share(hit[asks]), _share(hit[~asks]), int(hit.sum()), len(hit)))
            columns = list(zip(*out, strict=True)) or [()] * 8
            types = [pa.int64()] * 2 + [pa.float64()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[f.split(" ")[0] for f in FOUND.split(", ")])

    return run


def _runs(w: np.ndarray, width: int, k: int) -> np.ndarray:
    """Shingles of a text that an item with shingles of ``width`` words may share."""
    if width == k:
        return np.unique(shingles(w, np.array([0, len(w)]), k)[0])
    # an item of fewer than k words is one run, anywhere in the text
    n = max(0, len(w) - width + 1)
    windows = np.lib.stride_tricks.sliding_window_view(w, width).reshape(-1) if n else w[:0]
    return np.unique(shingles(windows, np.arange(n + 1) * width, k)[0])


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted ``known``."""
    if len(known) == 0:
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _share(hit: np.ndarray) -> float:
    """Share of a part's shingles that were found; a part without any is found."""
    return float(hit.mean()) if len(hit) else 1.0


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct terms and its length, which stands with a null term."""
    for batch in batches:
        h, at, _ = item_words(batch.column("text").to_pylist())
        n, owner = len(batch), np.repeat(np.arange(len(batch)), np.diff(at))
        row, first = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1, return_index=True) if len(h) else (np.zeros((2, 0), np.uint64), np.zeros(0, int))
        del first
        part = batch.column("part").to_numpy()
        cells = [
            pa.array(np.concatenate([part[row[0].astype(np.int64)], part])), pa.array(np.concatenate([row[1].view(np.int64), np.zeros(n, np.int64)]), mask=np.repeat([False, True], [row.shape[1], n])),
            pa.array(np.concatenate([np.zeros(row.shape[1], np.int64), np.diff(at)])),
        ]
        yield pa.RecordBatch.from_arrays(cells, names=["part", "term", "length"])


def _indexes(items: DataFrame, k: int, num: int, den: int) -> Iterator[Index]:
    """Indexes of all items of items(item_id, text), one a pass; statistics are those of all items."""
    spark = items.sparkSession
    work = Workspace(spark, "leaks")
    tests = items.where(F.col("text").rlike(r"[A-Za-z0-9]|[^\x00-\x7f]")).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // PASS_BYTES)
    tests = tests.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, passes))))
    if passes > 1:
        terms = work.put(tests.select("part", "text").mapInArrow(trimmed(_item_terms), "part long, term long, length long"), "terms")
        n, length = terms.where("term is null").agg(F.count("*"), F.sum("length")).first()
        frequency = work.put(terms.where("term is not null").groupBy("term").agg(F.count("*").alias("df")), "frequency")
    for p in range(passes):
        part = tests.where(F.col("part") == p).orderBy("item_id", "text").collect()  # about PASS_BYTES
        if not part:
            continue
        whole = None
        if passes > 1:
            mine = terms.where((F.col("part") == p) & F.col("term").isNotNull()).select("term").distinct()
            found = frequency.join(mine, "term").toArrow()  # the terms of a pass
            known = found["term"].to_numpy().view(np.uint64)
            order = np.argsort(known)
            whole = Collection(n, length / n, known[order], found["df"].to_numpy()[order])
        yield build([r["item_id"] for r in part], [r["text"] for r in part], k, num, den, whole)


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per leaked item and row of docs(doc_id, text) that holds it, for items(item_id, text).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded; a null
    or wordless document or item matches nothing.  An item of fewer than k words must
    occur as it is.  Very long texts are read whole.  Repeated documents are reported
    each, repeated items too.  Other columns are ignored; empty tables give no rows.
    """
    Workspace(docs.sparkSession, "leaks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for index in _indexes(items, k, num, den):
        found = rows.mapInArrow(trimmed(_match(index, k, num, den)), FOUND)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def without_leaks(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, of which ``find_leaks`` reports nothing; nothing is shuffled."""
    Workspace(docs.sparkSession, "leaks")

    def clean(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for row, *_ in _leaks(index, batch.column("text"), k, num, den):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in _indexes(items, k, num, den):
        docs = docs.mapInArrow(trimmed(clean(index)), docs.schema)
    return docs
