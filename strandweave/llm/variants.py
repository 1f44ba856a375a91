"""Spelling variants: each word's frequent neighbour at one edit, without pairs of words.

A replacement leaves a word's wildcard ``prefix*suffix`` as it is, so all words that differ
at one position meet in one group, as large as the alphabet at most.  A group keeps its
size and its two most frequent words: a member has size - 1 neighbours there, the best of
them being the first word, or the second for the first itself.  An insertion or deletion is
a deletion seen from one side: the distinct deletions of all words are grouped, each with
its number of sources and the best one, and meet the vocabulary once.  Everything is then
summed by word.

Groups and deletions of ordinary words are strings, made by DataFrame functions.  A word
of ``LONG`` code points or more would write out its square that way; it has the same
groups and deletions as fingerprints of a fixed size, made from running sums in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import Workspace, trimmed
from .urlblock import lower_ascii

RUN = r"[A-Za-zÀ-ÿ]"
#: Joins that follow a form to the last: each doubles the steps, and a form is ``ratio`` times as frequent as the word before.
DOUBLINGS = 6
#: Words up to this length have their groups and deletions as strings.
LONG = 64
#: (modulus, base) of fingerprints: 93 bits in all.
_PRIMES = ((2147483647, 1103515245), (2147483629, 715225739), (2147483587, 1597334677))
#: Places of a long word in one batch of rows.
PLACES = 1 << 17


def _left(word: Column, i: Column) -> Column:
    """The code points before place i (from 0)."""
    return F.substring(word, F.lit(1), i)


def _right(word: Column, i: Column) -> Column:
    """The code points after place i (from 0)."""
    return F.substring(word, i + 2, F.length(word))


def occurrences(docs: DataFrame, at_least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): words of whole texts after the deterministic damage, with their occurrences.

    A run of letters is lower-cased in A-Z; where ``every`` divides the unsigned crc32 h of
    ``<doc_id>:<run>``, its code point h % length goes.  Results shorter than ``at_least``
    are left out, and so are shorter runs before any work on them.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{RUN}{{{at_least},}}"), F.lit(0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    run = docs.where("text is not null").select(key.alias("key"), F.explode(runs).alias("run")).select("key", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "key", "run").cast("binary"))
    place = (h % F.length("run")).cast("int")
    word = F.when(h % every == 0, F.concat(_left(F.col("run"), place), _right(F.col("run"), place))).otherwise(F.col("run"))
    return run.select(word.alias("word")).where(F.length("word") >= at_least).groupBy("word").agg(F.count("*").alias("n"))


def _best(n: Column, word: Column) -> Column:
    """Smaller is better: more occurrences, then the word first in code-point order."""
    return F.struct((-n).alias("less"), word.alias("word"))


def _replaced(words: DataFrame) -> DataFrame:
    """(word, near, best) from groups of one wildcard; * is no letter of a word."""
    places = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    keyed = words.select("word", "n", places.alias("i")).select(F.concat(_left(F.col("word"), F.col("i")), F.lit("*"), _right(F.col("word"), F.col("i"))).alias("key"), _best(F.col("n"), F.col("word")).alias("w"))
    group = keyed.groupBy("key").agg(F.sort_array(F.collect_list("w")).alias("ws")).where(F.size("ws") > 1)
    member = group.select((F.size("ws") - 1).cast("long").alias("near"), F.col("ws")[0].alias("first"), F.col("ws")[1].alias("second"), F.explode("ws").alias("w"))
    return member.select("w.word", "near", F.when(F.col("w") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))


def _indels(words: DataFrame) -> DataFrame:
    """(word, near, best) from deletions that are words themselves, seen from both sides."""
    places = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    # neighbouring equal letters give the same deletion: only the first of such a stretch counts
    cut = words.select("word", "n", places.alias("i")).where((F.col("i") == 0) | (F.substring("word", F.col("i") + 1, F.lit(1)) != F.substring("word", F.col("i"), F.lit(1))))
    cut = cut.select("word", "n", F.concat(_left(F.col("word"), F.col("i")), _right(F.col("word"), F.col("i"))).alias("short"))
    met = cut.join(words.select(F.col("word").alias("short"), F.col("n").alias("short_n")), "short")
    longer = met.select(F.col("short").alias("word"), F.lit(1).cast("long").alias("near"), _best(F.col("n"), F.col("word")).alias("best"))
    return longer.union(met.select("word", F.lit(1).cast("long"), _best(F.col("short_n"), F.col("short"))))


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def _joined(parts: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(parts[0] << 31 | parts[1]), pa.array(parts[2])]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each long word: itself, itself without each place, itself with each place open and the letter that stood there."""
    for batch in batches:
        for wid, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
            code = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
            size = len(code)
            first = np.flatnonzero(np.diff(code, prepend=-1))  # of equal neighbours one deletion
            own, cut, held = [], [], []
            for prime, base in _PRIMES:
                term = code * _powers(size, base, prime) % prime
                before = np.concatenate([[0], np.cumsum(term)])  # 2**31 terms are far from 64 bits
                total = int(before[-1])
                own.append(np.array([total % prime]))
                held.append((total - term) % prime)
                cut.append((before[first] + (total - before[first + 1]) % prime * pow(base, -1, prime)) % prime)
            kinds = [("own", own, np.array([size]), np.zeros(1, np.int64)), ("cut", cut, np.full(len(first), size - 1), np.zeros(len(first), np.int64)), ("held", held, np.full(size, size), code)]
            for kind, parts, length, letter in kinds:
                if kind != "own" and size <= LONG:
                    continue  # an ordinary word; longer ones may lose a letter to become it
                place = np.arange(len(length)) if kind == "held" else np.zeros(len(length), np.int64)
                for a in range(0, len(length), PLACES):
                    b = min(a + PLACES, len(length))
                    same = [pa.array([kind] * (b - a)), *_joined([x[a:b] for x in parts])]
                    numbers = [pa.array(x[a:b].astype(np.int64)) for x in (length, place, letter)]
                    yield pa.RecordBatch.from_arrays([*same, *numbers, pa.array(np.full(b - a, wid)), pa.array(np.full(b - a, n))], names=["kind", "h", "g", "length", "place", "letter", "id", "n"])


def _long(words: DataFrame, work: Workspace) -> DataFrame:
    """(word, near, best) of words around and beyond ``LONG`` code points: one row each that has neighbours."""
    named = work.put(words.where(F.length("word") >= LONG).withColumn("id", F.monotonically_increasing_id()), "long")
    prints = work.put(named.select("id", "word", "n").mapInArrow(trimmed(_fingerprints), "kind string, h long, g long, length long, place long, letter long, id long, n long"), "prints")
    key = ["h", "g", "length"]
    # the words of one open place differ in the letter there, so their order is the letters'
    w = F.struct((-F.col("n")).alias("less"), "letter", "id").alias("w")
    group = prints.where("kind = 'held'").select(*key, "place", w).groupBy(*key, "place").agg(F.sort_array(F.collect_list("w")).alias("ws")).where(F.size("ws") > 1)
    member = group.select((F.size("ws") - 1).cast("long").alias("near"), F.col("ws")[0].alias("first"), F.col("ws")[1].alias("second"), F.explode("ws").alias("w"))
    other = F.when(F.col("w") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    near = member.select("w.id", "near", other["id"].alias("other"), other["less"].alias("less"))
    short = prints.where("kind = 'own'").select(*key, F.col("id").alias("short"), F.col("n").alias("short_n"))
    met = prints.where("kind = 'cut'").select(*key, "id", "n").join(short, key)
    one = F.lit(1).cast("long").alias("near")
    near = near.union(met.select("id", one, "short", -F.col("short_n"))).union(met.select("short", one, "id", -F.col("n")))
    # only the most frequent neighbours' words are looked up, to settle ties
    near = work.put(near, "long_near")
    best = near.groupBy("id").agg(F.sum("near").alias("near"), F.min("less").alias("less"))
    tied = near.select("id", "other", "less").distinct().join(best, ["id", "less"])
    spelled = tied.join(named.select(F.col("id").alias("other"), F.col("word").alias("best_word")), "other")
    settled = spelled.groupBy("id").agg(F.max("near").alias("near"), F.min(F.struct("less", F.col("best_word").alias("word"))).alias("best"))
    return settled.join(named.select("id", "word"), "id").select("word", "near", "best")


def _roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root) of words with a form: pointers are doubled until none moves."""
    now = work.put(forms.select("word", F.col("form").alias("root")), "roots0")
    for k in range(1, DOUBLINGS + 1):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = work.put(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{k}")
        moved = after.where("moved").limit(1).count() > 0
        now = after.select("word", "root")
        if not moved:
            return now
    raise RuntimeError("forms did not end")


def spelling_variants(docs: DataFrame, at_least: int = 7, least_n: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs(doc_id, text).

    ``n_near`` counts the words at one inserted, deleted or replaced code point; ``form`` is
    the most frequent of them (ties: first in code-point order) if it is at least ``ratio``
    times as frequent as the word, else null with ``form_n``; ``root`` follows forms to the
    last.  Texts null or without letters give no words, texts of any length are read whole,
    repeated rows count again, a null doc_id counts as an empty one in the hash, other
    columns are ignored, and an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word, else forms need not end")
    work = Workspace(docs.sparkSession, "variants")
    words = work.put(occurrences(docs, at_least, every).where(F.col("n") >= least_n), "words")
    none = F.lit(None).cast("struct<less: bigint, word: string>")
    parts = words.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best"))
    plain = words.where(F.length("word") <= LONG)
    for part in (_replaced(plain), _indels(plain), _long(words, work)):
        parts = parts.union(part.select("word", F.lit(None).cast("long"), "near", "best"))
    by_word = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = by_word.select("word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    found = work.put(found, "forms")
    roots = _roots(found.where("form is not null"), work)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
