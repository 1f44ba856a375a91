"""Language identification, URL rules, quality, leaks."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandweave.llm import langid, leaks, quality, urlblock
from strandweave.llm.registry import table

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = langid.fit(docs.where(~held))
    assert set(model.families) == {"germanic", "romance"} and ("de", "en") in model.pairs and ("es", "fr") in model.pairs
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the of and that", "en", 0.5), (2, "der die und das", "de", 0.5), (3, None, "en", 0.1), (4, "", None, 0.1), (5, "123 $$", "de", 0.0), (6, "le la", None, 0.0), (6, "le la", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[1][0] == "en" and got[2][0] == "de" and langid.identify(docs, model).count() == 7
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'"))
    assert langid.identify(docs.where("doc_id = 2"), one).first().lang_pred == "en"


def brute_urls(pages, rules):
    """Host, path, rule and verdict of (id, url, links) by plain search."""
    import re

    def parts(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")

    def fit(h, p):
        ok = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return max(ok, key=lambda r: len(r.text), default=None)

    def address(u):
        h, _ = parts(u)
        rest = re.search(r"://[^/?#]*([^#]*)", u or "")
        rest = rest[1] if rest else ""
        return h + ("/" + rest if rest == "" or rest[0] == "?" else rest) if h else None

    near = defaultdict(set)
    for _, u, links in pages:
        for v in links:
            if address(u) and address(v):
                near[address(u)].add(address(v))
                near[address(v)].add(address(u))
    out = {}
    for i, u, _ in pages:
        h, p = parts(u)
        own = fit(h, p)
        seen, todo = {address(u)}, [address(u)]
        while todo:
            for v in near[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        found = {r.verdict for a in seen if a and (r := fit(*parts("x://" + a)))}
        verdict = own.verdict if own else "allow" if "allow" in found or not found else "block"
        out[i] = (h, p, own.text if own else None, verdict)
    return out


RULES = [urlblock.Rule("allow", "com", "/"), urlblock.Rule("block", "example.com", "/en/"), urlblock.Rule("allow", "www.example.com", "/en/"), urlblock.Rule("block", "net", "/es/"), urlblock.Rule("block", "net", "/fr/")]


def test_urls(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "WWW.example.com", "b.net", "c.org", "d.org", "e.org", "f.org", "notexample.com"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in ["", "/", "/en/1", "/es/2?q=1", "/fr/3#top", "/x"]]
    pages, rows = [], []
    for i, u in enumerate([*urls, None, "no scheme", "ftp:/x", urls[3]]):
        links = rng.sample(urls, rng.choice([0, 0, 1, 2]))
        html = "".join(
            rng.choice([f'<link rel="canonical" href="{v.replace("&", "&amp;")}">', f"<META http-equiv=refresh content='0; URL={v}'>", f"<link href='{v}' rel='alternate canonical'/>"]) for v in links
        )
        html += '<link rel="stylesheet" href="http://b.net/es/no"><a href="http://b.net/es/no2">x</a>'
        pages.append((i, u, links))
        rows.append((i, u, html if i % 7 or links else None, "x"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urlblock.judge(df, RULES).collect()}
    assert got == brute_urls(pages, RULES) and {v[3] for v in got.values()} == {"allow", "block"}
    assert urlblock.judge(df.limit(0), RULES).count() == 0


def test_relative_links(spark):
    rows = [(1, "http://a.org/d/x?y", '<link rel=canonical href="/es/1">'), (2, "http://a.org/d/x2", "<link rel=canonical href=//b.net/es/1>"), (3, "http://a.org/d/x3", '<link rel=canonical href="z">'), (4, "http://a.org/d/x4", '<link rel=canonical href="mailto:x">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from strandweave.llm.cluster import Workspace

    got = {tuple(r) for r in urlblock.alias_links(df, Workspace(spark, "t")).collect()}
    assert got == {("a.org/d/x?y", "a.org/es/1"), ("a.org/d/x2", "b.net/es/1"), ("a.org/d/x3", "a.org/d/z")}
    assert {r.page_id: r.verdict for r in urlblock.judge(df, RULES).collect()} == {1: "allow", 2: "block", 3: "allow", 4: "allow"}
    more = spark.createDataFrame([("a.org/d/x4", "c.net/fr/1")], "a string, b string")
    assert {r.page_id: r.verdict for r in urlblock.judge(df, RULES, more).collect()}[4] == "block"


def test_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    train = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    got = quality.score(docs, quality.fit(docs, train)).join(labels, "doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.93
    assert (got[got.quality == 1].keep).mean() > 0.95


def test_quality_edges(spark):
    rows = [(i, f"good words here {i} again" if i % 2 else f"### {i} $$$ !!", None if i % 3 else "s", "en", i) for i in range(60)] + [(None, None, None, None, None), (1, "", "s", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (41, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.keep for r in quality.score(docs, model).where("doc_id > 41").collect()}
    assert all(keep == bool(i % 2) for i, keep in got.items()) and quality.score(docs, model).count() == 62
    assert quality.fit(docs, labels.where("quality = 1")) is None and quality.fit(docs.limit(0), labels) is None
    assert quality.score(docs, None).where("keep").count() == 62
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_matches_a_fit_in_memory(spark):
    """The rounds of tasks and passes give the model that co-training of all documents in memory gives."""
    docs = table(spark, SF, "documents").orderBy("doc_id").toPandas()
    labels = table(spark, SF, "labels").toPandas().dropna(subset=["quality"]).groupby("doc_id").quality.mean()
    text = np.concatenate([x for _, x in quality.text_features(pa.array(docs.text.fillna("").tolist()))]).astype(np.float16).astype(np.float32)
    none = lambda c: [None if v is None or v != v else v for v in docs[c].tolist()]
    meta = quality.metadata_features(none("source"), none("lang"), none("n_chars"))
    known = docs.doc_id.isin(labels.index).to_numpy()
    y = (labels.loc[docs.doc_id[known]].to_numpy() >= 0.5).astype(float)
    want = quality.co_train(text[known], meta[known], y, text[~known], meta[~known], float((labels >= 0.5).mean()))
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    got = quality.score(table(spark, SF, "documents"), model).orderBy("doc_id").toPandas()
    t, m, both = want.score(text, meta)
    for a, b in ((got.p_text, t), (got.p_metadata, m), (got.score, both)):
        assert np.abs(a.to_numpy() - b).max() < 0.02
    kept = quality.good(table(spark, SF, "documents"), model).toPandas()
    assert set(kept.doc_id) == set(got.doc_id[got.keep]) and list(kept.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_matches_a_fit_in_memory(spark):
    from strandweave.llm.bytegrams import features

    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").where("text is not null and lang is not null").toPandas()
    x = np.concatenate([x for _, x in features(pa.array(docs.text.tolist()), langid.BITS, langid.LETTERS)]).astype(np.float16)
    order = sorted(range(len(x)), key=lambda i: (docs.lang[i], x[i].tobytes()))
    direct = langid.train(x[order].astype(np.float32), docs.lang.to_numpy(object)[order])
    fitted = langid.fit(table(spark, SF, "documents"))
    assert fitted.pairs == direct.pairs and np.allclose(fitted.weights, direct.weights, atol=1e-5)
    lang, score = direct.predict(x.astype(np.float32))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(table(spark, SF, "documents"), fitted).collect()}
    same = [got[d][0] == a and abs(got[d][1] - b) < 0.02 for d, a, b in zip(docs.doc_id, lang, score) if got[d][0] != "und"]
    assert np.mean(same) > 0.995


def test_very_long_texts_and_clashing_columns(spark):
    """One text of a million words among short ones, and columns named like results."""
    long = "the quick brown fox jumps over the lazy dog " * 110_000
    rows = [(i, f"good words here {i} again" if i % 2 else f"### {i} $$$ !!", "s", "en", i, 0.1, "k", "l") for i in range(60)]
    rows += [(100, long, "s", "en", 10**6, 0.2, "k", "l"), (None, long, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double, keep string, lang_pred string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 62 and quality.good(docs, model).columns == docs.columns
    found = langid.fit(docs)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, found).collect()}
    assert got[100] == "en" and langid.recognised(docs, found, 0.3).where("doc_id = 100").first().score == 0.2
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog the quick brown")], "item_id long, text string")
    assert sorted(r.doc_id for r in leaks.find_leaks(docs, items).collect() if r.doc_id) == [100]


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(3)

    def draw(n):
        y = rng.integers(0, 2, n).astype(float)
        view = lambda: (y[:, None] * 2 - 1) * np.array([1.0, 0.5]) + rng.standard_normal((n, 2))
        return view().astype(np.float32), view().astype(np.float32), y

    text, meta, y = draw(40)
    pool = draw(2000)
    t2, m2, y2 = draw(4000)
    taught = quality.co_train(text, meta, y, pool[0], pool[1], 0.5)
    _, _, p = taught.score(t2, m2)
    assert ((p > 0.5) == (y2 > 0.5)).mean() > 0.9


def shingle_hits(doc, item, k=5):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    d, i = words(doc), words(item)
    n = min(k, len(i))
    if n == 0:
        return 0, 0
    mine = {tuple(i[a : a + n]) for a in range(len(i) - n + 1)}
    return len(mine & {tuple(d[a : a + n]) for a in range(len(d) - n + 1)}), len(mine)


def test_leaks(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "w%d" % rng.randrange(4000)
    said = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"{said(rng.randint(8, 40)).capitalize()}? {said(rng.randint(1, 9))}.") for i in range(60)] + [(90, "Tiny one."), (91, None), (92, "..."), (93, "")]
    docs = []
    for i in range(400):
        body = said(rng.randint(0, 300)).split()
        if i % 3 == 0:
            text = items[rng.randrange(61)][1].split()
            cut = rng.choice([0, 0, 1, 3, len(text) // 2])
            at = rng.randint(0, len(body))
            body[at:at] = text[: len(text) - cut]
        docs.append((i, " ".join(body).upper() if i % 5 == 0 else " ".join(body), "x"))
    docs += [(None, items[0][1], "x"), (400, None, "x"), (0, items[1][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared_shingles, r.item_shingles) for r in leaks.find_leaks(df, it).collect()}
    want = set()
    for d, t, _ in docs:
        for i, x in items:
            hit, n = shingle_hits(t, x)
            if n and 100 * hit >= 75 * n:
                want.add((d, i, hit, n))
    assert got == want and len(want) > 60
    assert leaks.find_leaks(df.limit(0), it).count() == 0 and leaks.find_leaks(df, it.limit(0)).count() == 0


def test_block_bounds_lose_nothing():
    rng = random.Random(3)
    texts = [" ".join("w%d" % rng.randrange(80) for _ in range(rng.randint(3, 30))) for _ in range(50)]
    index = leaks.build(list(range(50)), texts, 5)
    docs = [" ".join("w%d" % rng.randrange(80) for _ in range(rng.randint(0, 400))) for _ in range(30)]
    from strandweave.llm.bytewords import NOT_ALNUM, text_bytes, words

    raw, off = text_bytes(pa.array(docs))
    h, at = words(raw, off, NOT_ALNUM)
    got = {(t, i): x for t, i, x in leaks.search(index, h, at)}
    want = {}
    for t in range(30):
        mine = np.isin(index.vocab, h[at[t] : at[t + 1]])
        term = np.searchsorted(index.entry, np.searchsorted(index.posting, np.arange(len(index.item)), "right") - 1, "right") - 1
        scores = np.bincount(index.item, index.impact * mine[term], minlength=50)
        want |= {(t, int(i)): scores[i] for i in np.flatnonzero((scores >= index.theta) & (scores > 0))}
    assert set(want) <= set(got) and len(want) > 10
    assert all(abs(got[k] - x) < 1e-4 * x for k, x in want.items()) and len(got) <= len(want) + 2


def test_passes_share_their_statistics(spark, monkeypatch):
    rng = random.Random(4)
    said = lambda n: " ".join("w%d" % rng.randrange(400) for _ in range(n))
    items = spark.createDataFrame([(i, f"{said(12)}? {said(7)}.") for i in range(80)], "item_id long, text string")
    docs = spark.createDataFrame([(r.item_id, f"{said(40)} {r.text} {said(40)}") for r in items.collect()], "doc_id long, text string")
    once = sorted(map(tuple, leaks.find_leaks(docs, items).collect()))
    monkeypatch.setattr(leaks, "PASS_BYTES", 900)
    assert len(once) >= 80 and np.allclose(sorted(map(tuple, leaks.find_leaks(docs, items).collect())), once, rtol=1e-5)
    assert leaks.without_leaks(docs, items).count() == 0 and leaks.without_leaks(docs, items.limit(0)).count() == 80


def test_leaks_spread_over_a_document(spark):
    """Question and answer, or halves, hundreds of words apart, also the other way around."""
    rng = random.Random(5)
    said = lambda n, v="w": " ".join(v + str(rng.randrange(3000)) for _ in range(n))
    items = [(i, f"{said(rng.randint(12, 30)).capitalize()}? {said(rng.randint(6, 20))}.") for i in range(60)]
    docs = []
    for i in range(120):
        question, answer = leaks.split_item(items[i % 60][1])
        if i >= 60:
            both = f"{question} {answer}".split()
            question, answer = " ".join(both[: len(both) // 2]), " ".join(both[len(both) // 2 :])
        if i % 3 == 0:
            question, answer = answer, question
        docs.append((i, f"{said(100, 'x')} {question} {said(500, 'y')} {answer} {said(50, 'x')}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared_shingles, r.item_shingles) for r in leaks.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i, *shingle_hits(t, x)) for d, t in docs for i, x in items}
    want = {r for r in want if r[3] and 100 * r[2] >= 75 * r[3]}
    assert got == want and len(want) > 80


def test_leaks_of_common_terms(spark):
    """Items that all are alike have terms of hardly any weight."""
    items = spark.createDataFrame([(i, "Same?") for i in range(1100)], "item_id long, text string")
    docs = spark.createDataFrame([(0, "it is the same"), (1, "other")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()} == {(0, i) for i in range(1100)}
