"""Tokenizer alignment against a version that walks both token lists, with tokenizers of its own."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from strandweave.llm import alignment
from strandweave.llm.registry import table, tokenizer_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    a_bytes = {i: bytes(letter.get(c, 0) for c in t) for t, i in a.get_vocab().items()}
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, a_bytes, b_bytes


def brute(rows, sides):
    a, b, a_bytes, b_bytes = sides
    docs, n = [], Counter()
    for doc_id, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(a_bytes[i] for i in x) != want or b"".join(b_bytes[i] for i in y) != want:
            docs.append((doc_id, [], [], [], []))
            continue
        owner_a = [k for k, i in enumerate(x) for _ in a_bytes[i]]
        owner_b = [k for k, i in enumerate(y) for _ in b_bytes[i]]
        links = list(dict.fromkeys(zip(owner_a, owner_b, strict=True)))
        groups, left, right = [], [], []
        for p in range(len(want)):
            last_a = p + 1 == len(want) or owner_a[p + 1] != owner_a[p]
            last_b = p + 1 == len(want) or owner_b[p + 1] != owner_b[p]
            left += [str(x[owner_a[p]])] * last_a
            right += [str(y[owner_b[p]])] * last_b
            if last_a and last_b:
                groups.append(",".join(left) + "|" + ",".join(right))
                left, right = [], []
        docs.append((doc_id, x, y, [(x[i], y[j]) for i, j in links], groups))
        n.update(docs[-1][3])
    top = defaultdict(int)
    for (_, j), k in n.items():
        top[j] = max(top[j], k)
    out = Counter()
    for doc_id, x, y, links, groups in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out[doc_id, len(x), len(y), len(groups), len(links), sum(n[p] == top[p[1]] for p in links), sum(n[p] for p in links), sha] += 1
    return out, {(i, j, k, k == top[j]) for (i, j), k in n.items()}


def run(spark, df):
    got = alignment.align(df, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return Counter(tuple(r) for r in got.documents.collect()), {tuple(r) for r in got.pairs.collect()}


def odd_texts(n):
    rng = random.Random(3)
    parts = [*"ab  \n\t.,1é😀<|'s̈ 　", "<|endoftext|>", "<s>", "</s>", "  ", "the", "hello", " ▁ ", "<0x41>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_small_chunks_and_slots(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)  # several slots and levels of sums
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(odd_texts(300))]
    rows += [(None, "hello world"), (None, None), (7, "hello world"), (7, "hello world"), (8, ""), (9, " "), (10, "word " * 60_000), (11, "x" * 20_000)]
    got = run(spark, spark.createDataFrame(rows, SCHEMA).repartition(9))
    want = brute(rows, sides)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_chunk_bounds_do_not_matter(sides, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from strandweave.llm.bytewords import text_bytes

    linker = alignment._Linker(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    texts = odd_texts(60) + ["plain words of a text " * 30]
    whole = linker.chunk(*text_bytes(pa.array(texts)))
    parts = [linker.chunk(*text_bytes(pa.array([t]))) for t in texts]
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        assert whole[name].tolist() == [int(p[name][0]) for p in parts]
    assert whole["groups_sha256"] == [p["groups_sha256"][0] for p in parts]
    assert int(whole["counts"].sum()) == sum(int(p["counts"].sum()) for p in parts)
    packed = alignment._pack(whole["codes"].astype(np.uint32)[:5], whole["counts"][:5])
    assert [x.tolist() for x in alignment._unpack(packed)] == [whole["codes"].astype(np.uint32)[:5].tolist(), whole["counts"][:5].tolist()]


def test_other_columns_and_no_rows(spark, sides):
    df = spark.createDataFrame([(1, "a text", "x", 3)], SCHEMA + ", links string, n_a int")
    got = run(spark, df)
    assert got == brute([(1, "a text")], sides)
    assert run(spark, df.limit(0)) == (Counter(), set())
