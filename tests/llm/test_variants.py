"""Spelling variants against a version that tries all edits of every word."""

import re
import zlib
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandweave.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def brute(rows, at_least=7, least_n=2, ratio=10, every=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= at_least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least_n}
    near = defaultdict(set)
    letters = {c for w in n for c in w}
    for w in n:
        for i in range(len(w)):
            for v in [w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in letters)]:
                if v != w and v in n:
                    near[w].add(v)
                    near[v].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v))
        if n[best] >= ratio * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def run(spark, rows, **kw):
    got = variants.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()
    assert len(got) == len({r["word"] for r in got})
    return {tuple(r) for r in got}


def test_chains_ties_and_edges(spark):
    many = {"abcdefg": 300, "abcdefh": 25, "abcdeeh": 2, "abcdefgh": 300, "bcdefghi": 3, "ÀÉÎõöüß": 2, "ÀÉÎõöü": 30, "mississippi": 40, "misissippi": 3, "missisippi": 4, "aaaaaaaa": 50, "aaaaaaa": 4}
    rows = [(i, " ".join([w] * k)) for i, (w, k) in enumerate(many.items())]
    long = "".join(chr(97 + i * i % 23) for i in range(300))
    for k, word in ((40, long), (3, long[:50] + long[51:]), (4, long[:50] + "z" + long[51:]), (4, long[:50] + "y" + long[51:]), (2, long + long[-1]), (30, long[:63]), (3, long[:64]), (2, long[:65]), (3, long[1:65])):
        rows.append((len(rows) + 70, " ".join([word] * k)))
    rows += [(None, "Abcdefg ABCDEFG"), (50, None), (51, ""), (52, "123 ... \n"), (3, rows[3][1]), (60, "x" * 100_000 + " " + "ab×÷cdeé " * 20_000)]
    got = run(spark, rows)
    assert got == brute(rows)
    roots = {r[0]: r[2] for r in got}
    assert roots["abcdeeh"] == roots["abcdefh"] != "abcdefh"  # two steps
    assert run(spark, rows[:-1], at_least=3, least_n=1, ratio=2, every=3) == brute(rows[:-1], 3, 1, 2, 3)
    huge = rows + [(61, "x" * 100_000 + " " + "x" * 99_999)]
    got = run(spark, huge)
    assert sorted((len(r[0]), r[3:]) for r in got if len(r[0]) > 9999) == [(100_000, (2, 0, None))]
    got = run(spark, huge, least_n=1, ratio=2, every=10**9)
    assert sorted((len(r[0]), *r[3:]) for r in got if len(r[0]) > 9999) == [(99_999, 1, 1, 2), (100_000, 2, 1, None)]
    assert run(spark, []) == set()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abÀÿ ", min_size=0, max_size=60), max_size=30))
def test_dense_vocabularies(spark, texts):
    rows = list(enumerate(texts))
    assert run(spark, rows, at_least=2, least_n=1, ratio=3) == brute(rows, 2, 1, 3)


def test_other_columns_do_not_matter(spark):
    rows = [(1, "variant Variant variants", "word", 5), (2, "variants", "n", 6)]
    df = spark.createDataFrame(rows, SCHEMA + ", word string, n int")
    assert {tuple(r) for r in variants.spelling_variants(df).collect()} == brute([r[:2] for r in rows])
