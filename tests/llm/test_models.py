"""The Jaccard join, nearest neighbours, the language model and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import ann, components, jaccard, lm
from strandweave.llm.cluster import Workspace


def brute_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = brute_words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = union_find(links, ids)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def near_copies(rng, base, n, rate):
    return [" ".join(w if rng.random() > rate else f"m{rng.randrange(10**6)}" for w in base) for _ in range(n)]


def documents(seed):
    rng = random.Random(seed)
    said = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passage = said(60)
    texts = [None, "", "  \n", "one", "ONE", "two three", "a b c d e", "a b c d e f", "A b c d e  f", "a b c d e f g"]
    texts += near_copies(rng, said(200), 60, 0.012)  # a long list, most pairs similar
    texts += near_copies(rng, said(120), 50, 0.03)  # many pairs on either side of the threshold
    for n in range(6, 22):
        base = said(n)
        texts += [" ".join(base), " ".join(base + ["x"]), " ".join(["y"] + base), " ".join(base[:-1] + ["z"]), " ".join(base[1:])]
    texts += [" ".join(said(30) + passage + said(30)) for _ in range(40)]  # a common passage
    texts += [" ".join(passage)] * 5
    chain = said(100)
    texts += [" ".join(chain[3 * i : 3 * i + 60]) for i in range(13)]  # linked one after another
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_matches_brute_force(spark, seed):
    rows = documents(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()}
    assert got == brute_jaccard(rows)


@pytest.mark.parametrize("boundary", [0, 5, jaccard.SMALL])
def test_any_boundary_gives_the_same(spark, monkeypatch, boundary):
    rows = [r for r in documents(3) if len((r[1] or "").split()) < 30]
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *a: boundary)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()} == brute_jaccard(rows)


@pytest.mark.parametrize("rounds", [0, 3])
def test_hot_lists_in_blocks_lose_nothing(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "HOT", 0)  # every shingle's entries are spread, and all its lists long
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "CENTRAL_ROUNDS", rounds)
    rows = documents(1) + [(10_000 + i, f"same words in every one of these copies {i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()} == brute_jaccard(rows)


def test_copies_are_posted_once_a_task():
    batch = pa.RecordBatch.from_pydict({"text": ["a b c d e f g h"] * 50 + ["x y z u v w"] * 50})
    post = jaccard._post(5, np.zeros(jaccard.SKETCH, np.uint8), 0, 4, 75, 100, jaccard.HOT)
    sent = np.concatenate([np.frombuffer(b, np.uint64) for out in post(iter([batch, batch])) for b in out.column("keys").to_pylist()])
    assert len(sent) == jaccard.prefix_length(4, 75, 100) + jaccard.prefix_length(2, 75, 100)


def test_boundary_follows_cost():
    cheap = jaccard.choose_boundary({5: 10, 12: 10}, {5: 1.0, 12: 1.0}, 75, 100)
    dear = jaccard.choose_boundary({5: 10, 12: 10}, {5: 1e9, 12: 1e9}, 75, 100)
    assert cheap < dear
    assert jaccard.choose_boundary({}, {}, 75, 100) == 0


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, None), (9, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()), key=str)
    assert got == sorted([(None, 1, 4), (4, 1, 4), (4, 1, 4), (None, 0, None), (9, 0, 9)], key=str)
    assert jaccard.similar_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3), (41, 40), (40, 41)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components.components(df, "a", "b").collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    want = union_find(real, {x for p in real for x in p})
    assert got == want
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 24)) * 3
    x = (centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 24))).astype(np.float32)
    x[1500:1900] = x[1500]  # a hot vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(5000, None, "x"), (5020, [0.0] * 24, "x"), (5040, [1.0] * 23 + [None], "x"), (5060, [1.0] * 23 + [float("nan")], "x"), (5080, [float("inf")] * 24, "x"), (5100, [1.0] * 3, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.neighbours(df, df.where("vec_id % 20 = 0")).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 3000, 20))
    hits, d = 0, x.astype(np.float64)
    for q, part in got.groupby("query_id"):
        s = (d * d[q]).sum(axis=1)
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part.score, s[part.vec_id], rtol=1e-12)
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id)) and q not in set(part.vec_id)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -s))[:20]) & set(part.vec_id))
    assert hits / (20 * 150) >= 0.9
    few = ann.neighbours(df.where("vec_id < 5"), df.where("vec_id = 0"))
    assert few.count() == 4
    assert ann.neighbours(df.where("vec_id = 5000"), df).count() == 0 and ann.neighbours(df.limit(0), df.limit(0)).count() == 0


def exact(x, q, k):
    s = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k]


def recall_of(got, x, k):
    return np.mean([len(set(exact(x, q, k)) & set(part.vec_id)) / k for q, part in got.groupby("query_id")])


def test_neighbours_of_the_table(spark):
    """Against brute force, abandoning included."""
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(t.embedding).astype(np.float32)
    assert t.vec_id.tolist() == list(range(len(x)))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall_of(ann.neighbours(df, df.where("vec_id % 20 = 0")).toPandas(), x, 20) >= 0.9


@pytest.mark.parametrize("ranked", [3, 1 << 22])
def test_queries_aim_at_all_chunks_of_their_lists_alone(monkeypatch, ranked):
    monkeypatch.setattr(ann, "RANKED", ranked)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    radius = {0: float(np.linalg.norm(x, axis=1).max())}
    lists = ann.fit(x, np.zeros(400, int), {0: 400}, radius, 8, "f8", 20)
    home = lists.home(x, np.zeros(400, int))
    size = np.bincount(home, minlength=len(lists.centres)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(-(-size // 7))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([v.tobytes() for v in x[:50]], pa.binary())], names=["id", "body"])
    got = {}
    for out in ann._aim(lists, size, first, 5, 3, 21)(iter([batch])):
        for r in out.to_pylist():
            assert r["body"] == x[r["id"]].tobytes() and (r["id"], r["shelf"]) not in got
            got[r["id"], r["shelf"]] = {r["shelf"] * 5 + int(b) for b in np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8)))}
    order = lists.order(lists.turned(x[:50])[0])
    for q in range(50):
        n = max(3, int((np.cumsum(size[order[q]]) < 21).sum()) + 1)
        want = {c for e in order[q][:n].tolist() for c in range(first[e], first[e + 1])}
        assert set().union(*(v for k, v in got.items() if k[0] == q)) == want and all(v for k, v in got.items() if k[0] == q)


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 40, "SHELF": 3, "HELD": 7, "QUERIES": 5, "PAIRS": 100, "SAMPLE": 300, "RANKED": 50}])
def test_neighbours_of_unlike_norms(spark, monkeypatch, limits):
    """Doubles, outliers, repeated rows, clashing columns; small limits give the same kind of answer."""
    for name, value in limits.items():
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((10, 16)) * 2
    x = centres[rng.integers(0, 10, 1200)] + rng.standard_normal((1200, 16))
    x[7] *= 1e12
    x[8] *= 1e-9
    x[100:160] *= 50
    x[400:600] = x[400]  # a third of the queries ask the same
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)] + [(20, x[20].tolist(), 2, "y"), (3, x[3].tolist(), 2, "y"), (None, x[0].tolist(), 1, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, shelf string")
    got = ann.neighbours(df, df.where("vec_id % 5 = 0")).toPandas()
    assert len(got) == 240 * 20 and recall_of(got, x, 20) >= 0.9
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert np.allclose(part.score, x[part.vec_id] @ x[q], rtol=1e-12) and part.vec_id.is_unique
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id)) and q not in set(part.vec_id)


def test_copies_of_a_query_ask_once_whatever_lists_they_probe():
    x = np.random.default_rng(3).standard_normal((60, 8))
    radius = float(np.linalg.norm(x, axis=1).max())
    lists = ann.fit(x, np.zeros(60, int), {0: 60}, {0: radius}, 8, "f8", 1)
    rows = pa.RecordBatch.from_pydict({"list": [0] * 60, "salt": [i // 30 for i in range(60)], "id": list(range(60)), "body": [v.tobytes() for v in x]})
    held = [c for out in ann._chunks(lists, np.array([0, 2]))(iter([rows])) for c in out.to_pylist()]
    empty = {c: None for c in ("chunk", "id", "body", "bits", "list", "bit", "ids", "original", "columns")}
    asked = [{**empty, "place": 0, "id": 7, "body": x[7].tobytes(), "bits": bytes([b])} for b in (0b10000000, 0b11000000)]
    stand = [{**empty, **c, "place": 0, "bit": c["chunk"]} for c in held]
    types = [("place", pa.int64()), ("chunk", pa.int64()), ("id", pa.int64()), ("body", pa.binary()), ("bits", pa.binary()), ("list", pa.int32()), ("bit", pa.int32())]
    schema = pa.schema([*types, *((c, pa.binary()) for c in ("ids", "original", "columns"))])
    batch = pa.RecordBatch.from_pylist(asked + stand, schema=schema)
    got = [r for out in ann._search(lists, 20)(iter([batch])) for r in out.to_pylist()]
    score = x @ x[7]
    assert sorted(r["vec_id"] for r in got) == sorted(sorted((i for i in range(60) if i != 7), key=lambda i: -score[i])[:20])


def test_scan_drops_only_the_far():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((64, 500)).astype(np.float32), rng.standard_normal((3, 64)).astype(np.float32)
    x[:, :60] = q[0][:, None] + 0.3 * rng.standard_normal((64, 60))
    d = ((x.T[None] - q[:, None]) ** 2).sum(axis=2)
    most = np.sort(d, axis=1)[:, 20]
    row, at, near = ann.scan(q, x, most)
    assert np.allclose(near, d[row, at], rtol=1e-4) and set(at[row == 0]) == set(np.flatnonzero(d[0] <= most[0] + 1e-5))
    some = {(r, c) for r, c in zip(row.tolist(), at.tolist())}
    true = {(r, c) for r in range(3) for c in np.flatnonzero(d[r] <= most[r])}
    assert len(some & true) >= 0.9 * len(true)


def test_an_outlier_keeps_the_tests_sharp():
    """Vectors of one norm and one a thousand times as long: bands have radii of their own."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[0] *= 1000
    band = np.floor(np.log2(np.linalg.norm(x, axis=1)) + 0.5).astype(int)
    counts = dict(Counter(band.tolist()))
    radius = {b: float(np.linalg.norm(x[band == b], axis=1).max()) * (1 + 1e-12) for b in counts}
    lists = ann.fit(x, band, counts, radius, 32, "f8", 40)
    assert len(counts) == 2 and len(lists.centres) >= 40
    mine = np.flatnonzero(band == 0)
    columns = (ann.lifted(x[mine], radius[0]) @ lists.turn).T
    turned, _ = lists.turned(x[[5]])
    d = ((columns.T - turned[0]) ** 2).sum(axis=1)
    row, _, _ = ann.scan(turned, columns, np.sort(d)[[20]])
    assert 15 <= len(row) <= 21


def corpus(seed, n=120):
    rng = random.Random(seed)
    follows = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(3)] for i in range(60)}
    rows = []
    for i in range(n):
        w = ["w0"]
        while len(w) < rng.randint(1, 60):
            w.append(rng.choice(follows.get(w[-1], ['w0'])) if rng.random() < 0.9 else f"n{rng.randrange(500)}")
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (None, "w0 w1"), (902, "W0 w0"), (902, "W0 w0")]


def held(i):
    import zlib

    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0


def test_language_model(spark):
    rows = corpus(8)
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    got = sorted(lm.score(df, held_out()).collect(), key=str)
    c = Counter(x for i, t in rows if not held(i) for x in [*brute_words(t), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    want = {i: [*brute_words(t), None] for i, t in rows}
    for r in got:
        w = want[r.doc_id]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held(r.doc_id))
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and r.score <= 1e-9
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score(df.limit(0), held_out()).count() == 0
    none = lm.score(df.where("doc_id < 5"), F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(abs(r.score) < 1e-12 for r in none)


def test_probabilities_sum_to_one():
    """Over all known words and the slot of unknown ones, in the word restaurant and in a context."""
    rng = np.random.default_rng(4)
    customers = rng.integers(0, 30, 50)
    tables = np.minimum(customers, rng.integers(1, 5, 50)) * (customers > 0)
    top = lm.Top(50, int(customers.sum()), int(tables.sum()))
    parent = top.probability(np.append(customers, 0), np.append(tables, 0))
    assert abs(parent.sum() - 1) < 1e-12
    count, d = np.append(rng.integers(0, 4, 50), 0), 0.7
    t = np.minimum(count, 1)
    own = (count - d * t + (lm.STRENGTH + d * t.sum()) * parent) / (lm.STRENGTH + count.sum())
    assert abs(own.sum() - 1) < 1e-12


def test_seating_counts():
    rng = np.random.default_rng(1)
    c = np.array([1, 2, 3, 10, 2000, 100000])
    many = c > lm.FEW
    sizes, t = lm.seat(c, np.full(6, 0.5), 0.7, rng)
    assert (np.add.reduceat(sizes, np.cumsum(t) - t) == c).all() and (t >= 1).all() and (t <= c).all()
    sizes = sizes[np.repeat(many, t)]
    for _ in range(3):
        sizes, t = lm.gibbs(c, sizes, t, np.full(6, 0.01), np.full(6, 5.0), 1.0, 0.7, rng)
        assert (np.add.reduceat(sizes, np.cumsum(t[many]) - t[many]) == c[many]).all() and (sizes > 0).all() and (t <= c).all()


def test_gibbs_reaches_the_exact_posterior():
    """Two customers of one dish share a table with probability (1 - d) / (1 - d + (strength + d * (outside + 1)) * parent)."""
    rng = np.random.default_rng(2)
    m, d, strength, parent, outside = 20000, 0.6, 1.0, 0.2, 3.0
    c = np.full(m, 2)
    _, t = lm.gibbs(c, np.zeros(0, np.int64), np.ones(m, np.int64), np.full(m, parent), np.full(m, outside), strength, d, rng)
    together = (1 - d) / (1 - d + (strength + d * (outside + 1)) * parent)
    assert abs((t == 1).mean() - together) < 0.02


def table_posterior(c, parent, outside, strength, d):
    """Probabilities of 1 to c tables, by the recursion of generalized Stirling numbers, in logarithms."""
    s = np.full(c + 1, -np.inf)
    s[1] = 0.0
    t = np.arange(c + 1)
    for n in range(1, c):
        with np.errstate(divide="ignore"):
            stay = s + np.log(np.maximum(n - d * t, 0))
        s = np.logaddexp(stay, np.append(-np.inf, s[:-1]))
    s[1:] += np.cumsum(np.log((strength + d * (outside + np.arange(c))) * parent))
    p = np.exp(s - s.max())
    return p / p.sum()


@pytest.mark.parametrize(("c", "parent", "outside", "d"), [(17, 0.3, 4.0, 0.6), (60, 0.2, 10.0, 0.4), (1000, 0.05, 200.0, 0.7), (3000, 0.02, 300.0, 0.8), (3000, 0.05, 2000.0, 0.8)])
def test_gibbs_reaches_the_posterior_of_frequent_dishes(c, parent, outside, d):
    """After three sweeps, as the model has."""
    rng = np.random.default_rng(7)
    m = 2000
    p = table_posterior(c, parent, outside, 1.0, d)
    mean = (p * np.arange(c + 1)).sum()
    deviation = np.sqrt((p * (np.arange(c + 1) - mean) ** 2).sum())
    many = np.full(m, c)
    sizes, t = lm.seat(many, np.full(m, (1.0 + d * outside) * parent), d, rng, np.full(m, parent))
    if few := c <= lm.FEW:
        sizes = sizes[:0]
    for _ in range(3):
        sizes, t = lm.gibbs(many, sizes, t, np.full(m, parent), np.full(m, outside), 1.0, d, rng)
    assert few or (np.add.reduceat(sizes, np.cumsum(t) - t) == c).all() and (sizes > 0).all()
    assert abs(t.mean() - mean) < 0.2 * deviation, (t.mean(), mean, deviation)
    assert abs(t.std() - deviation) < 0.15 * deviation


def test_seating_is_kept_when_customers_come_and_go():
    rng = np.random.default_rng(8)
    old = np.array([1, 5, 100, 100, 7, 50000])
    sizes, t = lm.seat(old, np.full(6, 0.8), 0.8, rng)
    c = np.array([4, 2, 100, 130, 1, 49000])
    again, after = lm.resized(old, c, sizes, t, np.full(6, 0.8), 0.8, rng)
    at, to = np.cumsum(t) - t, np.cumsum(after) - after
    assert (np.add.reduceat(again, to) == c).all() and (again > 0).all()
    assert (again[to[2] : to[2] + after[2]] == sizes[at[2] : at[2] + t[2]]).all()


def test_planes_round_trip():
    for x in (np.array([], np.int64), np.array([0, 0]), np.array([1, 255, 256, 2**40]), np.array([2**64 - 1], np.uint64)):
        assert (lm.arr(lm.planes(x), x.dtype) == x).all() and lm.count_of(lm.planes(x)) == len(x)


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    docs, before = read("documents"), None
    work = Workspace(spark, "test-pipeline")
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, work.put(stage(spark, docs, sf), name)
        assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            comp = brute_jaccard(rows)
            assert {r.doc_id for r in docs.collect()} == {i for i, _ in rows if comp[i][1] == i}
        if name == "decontamination":
            from .test_filters import shingle_hits

            items = [r.text for r in read("benchmark").collect()]
            bad = {r.doc_id for r in before.collect() if any((h := shingle_hits(r.text, x)) and h[1] and 100 * h[0] >= 75 * h[1] for x in items)}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
    kept = {r.doc_id for r in docs.collect()}
    packed = cp.run(spark, sf).toPandas()
    assert set(packed.doc_id) == kept and packed.groupby("sequence_id").length.sum().max() <= 1024
    labels = {r.doc_id: r.quality for r in read("labels").collect()}
    gone = {r.doc_id for r in read("documents").collect()} - {r.doc_id for r in cp.drop_low_quality(spark, read("documents"), sf).collect()}
    known = [i for i in labels]
    assert np.mean([(i in gone) == (labels[i] == 0) for i in known]) > 0.93


@pytest.mark.parametrize("seed", [1, 2])
def test_no_row_falls_for_its_id(spark, seed):
    """Repeated and null ids: each group of linked texts keeps one row, and no other row goes."""
    import corpus_pipeline as cp

    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 9**9)}" for _ in range(rng.choice([3, 12, 60]))] for _ in range(12)]
    rows = []
    for _ in range(150):
        t = list(rng.choice(base))
        if rng.random() < 0.4:
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 5)}"
        rows.append((rng.choice([None, *range(8)]), rng.choice([None, "", " \n"]) if rng.random() < 0.1 else rng.choice([" ", "  ", "\n"]).join(t)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, "").collect())
    texts = {t for _, t in rows}
    comp = brute_jaccard(list(enumerate(sorted(t for t in texts if t and t.strip()))))
    name = {t: comp[i][1] for i, t in enumerate(sorted(t for t in texts if t and t.strip()))}
    want = {}
    for i, t in rows:
        if t in name:
            want.setdefault(name[t], set()).add((i is None, i or 0))
    assert sorted((name[t], i is None, i or 0) for i, t in kept.elements() if t in name) == sorted((c, *min(ids)) for c, ids in want.items())
    assert Counter({x: n for x, n in kept.items() if x[1] not in name}) == Counter(r for r in rows if r[1] not in name)


def test_unlike_texts_of_one_id(spark):
    import corpus_pipeline as cp

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, a), (2, a), (2, b), (7, c), (7, c[:-3] + "zz")]], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r.doc_id, r.text[:1]) for r in cp.drop_near_duplicates(spark, docs, "").collect())
    assert left == [(1, "a"), (2, "b"), (7, "c")]


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
    rows = [(1, None, None, None, None), (None, "some words of a text", "en", "s", 3), (2, "", "en", "s", 0), (3, "the same words here now", "en", "s", 1), (3, "the same words here now", "en", "s", 1), (4, "the same words here now", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    assert {r.doc_id for r in cp.drop_unknown_language(spark, docs, str(tmp_path)).collect()} == {None, 3, 4}
    left = cp.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted((str(r.doc_id) for r in left.collect())) == ["1", "2", "3", "None"]
    assert cp.drop_low_quality(spark, docs, str(tmp_path)).count() == 6 and cp.drop_leaks(spark, docs, str(tmp_path)).count() == 6
