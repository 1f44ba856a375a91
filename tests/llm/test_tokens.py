"""Tokenizing, token files, packing and chat formatting."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandweave.llm import bpe, bytewords, chat, packing, tokenfile
from strandweave.llm.cluster import Workspace
from strandweave.llm.registry import tokenizer_path

TRICKY = [
    "", None, " ", "a", "  a b", "  x  y\u3000 z", "é è  ê ç", "don't  'S 's\n\n x \t y ", "<|endoftext|> hi", "hello <|endoftext|>", "a<|endoftext|><|endoftext|>\n<|endoftext|", "ab   c", "x\u00a0 \u00a0 foo", "ü  ö", "日本 語 テキ スト", "a" * 5000 + " b",
    "A.\nB\n\nC! \n D", "x\r\ny", "#1's 'll", "end.\n",
]


def brute_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())  # as the library has it, untouched by ours


def noise(n, seed, alphabet="ab A.!\n,'s\t 12é\u00a0\u3000ß日\u0085 #"):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(n)]


def test_chunked_encoding_equals_the_library(tokenizer):
    texts = TRICKY + noise(5000, 1)
    for first, ids, at in bpe.encode_column(pa.array(texts), tokenizer_path(), limit=1 << 14):
        for i in range(len(at) - 1):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(texts[first + i] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("control", [True, False])
def test_other_files_and_plain_control_strings(name, control):
    """A file with another pre-tokenizer is encoded whole; control strings are text if so asked."""
    own = Tokenizer.from_file(tokenizer_path(name))
    own.encode_special_tokens = not control
    texts = [t for t in TRICKY if t is not None] + noise(300, 4) + ["A Word <|startoftext|>here<|endoftext|>"]
    for first, ids, at in bpe.encode_column(pa.array(texts), tokenizer_path(name), limit=1 << 12, control=control):
        for i in range(len(at) - 1):
            assert ids[at[i] : at[i + 1]].tolist() == own.encode(texts[first + i], add_special_tokens=False).ids


def test_a_hash_that_meets_another_chunk_does_no_harm(tokenizer, monkeypatch):
    """Ids are compared with the text they stand for: even a hash of three bits gives the library's ids."""
    real = bpe.hash_spans
    monkeypatch.setattr(bpe, "hash_spans", lambda *a: real(*a) & np.uint64(7))
    coder = bpe.ByteEncoder(tokenizer_path(), True)
    texts = noise(200, 6)
    raw, off = bytewords.text_bytes(pa.array(texts))
    ids, at = coder.encode(raw, off)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_and_shingles():
    texts = TRICKY + noise(500, 2)
    raw, off = bytewords.text_bytes(pa.array(texts))
    h, at = bytewords.words(raw, off)
    s, s_at = bytewords.shingles(h, at, 5)
    word_of, shingle_of = {}, {}
    for i, t in enumerate(texts):
        w = brute_words(t)
        assert len(w) == at[i + 1] - at[i]
        for a, b in zip(w, h[at[i] : at[i + 1]].tolist(), strict=True):
            assert word_of.setdefault(a, b) == b
        want = [tuple(w[j : j + 5]) for j in range(len(w) - 4)] or ([tuple(w)] if w else [])
        assert len(want) == s_at[i + 1] - s_at[i]
        for a, b in zip(want, s[s_at[i] : s_at[i + 1]].tolist(), strict=True):
            assert shingle_of.setdefault(a, b) == b
    assert len(set(word_of.values())) == len(word_of) and len(set(shingle_of.values())) == len(shingle_of)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1001])
def test_coding_round_trip(n):
    x = np.random.default_rng(n).choice([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], n).astype(np.uint32)
    control, data = tokenfile.pack_ids(x)
    assert len(control) == -(-n // 4) and (tokenfile.unpack_ids(control, data, n) == x).all()


def test_token_file(spark, tokenizer):
    rows = [(7 * i % 301, t, 1) for i, t in enumerate(TRICKY + noise(200, 3))] + [(None, "no id", 2), (5, "twice", 1), (5, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = Workspace(spark, "test").path("f")
    tokenfile.write_token_file(docs, tokenizer_path(), out)
    got = [tuple(r) for r in tokenfile.read_token_file(spark, out, tokenfile.digest, tokenfile.DIGEST_SCHEMA).collect()]
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    tokenfile.write_token_file(docs.limit(0), tokenizer_path(), out)
    assert tokenfile.read_token_file(spark, out).count() == 0


def test_packing(spark, tokenizer):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "of", "xq"], k=rng.choice([0, 3, 50, 400, 1022, 1023, 1024, 3000]))), "x") for i in range(120)] + [(None, None, "x"), (3, "again", "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), tokenizer_path()).toPandas()
    by_bin = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_bin.length.sum() <= 1024).all()
    assert (by_bin.offset.transform(lambda o: o) == by_bin.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length).all()
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in rows)
    whole, cut = [], {}
    for r in got.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for key, part in got[got.doc_id.notna() & (got.doc_id != 3)].groupby("doc_id"):
        part = part.sort_values("piece")
        cut[key] = [i for b in part.ids for i in np.frombuffer(b, "<u4").tolist()]
        assert part.start.tolist() == (part.length.cumsum() - part.length).tolist() and (part.length[1:] == 1024).all()
        assert len(part) == -(-len(cut[key]) // 1024)
    whole = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows if i is not None and i != 3}
    assert cut == whole and got.length.sum() == sum(map(len, want))
    assert got.sequence_id.nunique() <= 1.03 * np.ceil(got.length.sum() / 1024) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def one_by_one(counts):
    """Best-two-fit, a bin at a time."""
    left, bins = list(counts), []
    cap = len(counts) - 1
    while any(left):
        bin_, gap = [], cap
        while (fit := max((x for x in range(1, gap + 1) if left[x]), default=0)):
            bin_.append(fit)
            left[fit] -= 1
            gap -= fit
        if gap and len(bin_) > 1:
            wide = gap + bin_[-1]
            left_now = [(a, b) for a in range(1, wide) if left[a] for b in range(a, wide - a + 1) if left[b] > (a == b)]
            best = max((a + b for a, b in left_now), default=0)
            if best > bin_[-1]:
                # the pair whose first length is least
                a, b = min(p for p in left_now if sum(p) == best)
                left[bin_.pop()] += 1
                bin_ += sorted((a, b), reverse=True)
                left[a] -= 1
                left[b] -= 1
        bins.append(tuple(bin_))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_bulk_plan_equals_bin_by_bin(seed):
    rng = np.random.default_rng(seed)
    counts = np.concatenate([[0], rng.integers(0, 6, 24)])
    got = [tuple(p) for p, t in packing.best_two_fit(counts) for _ in range(t)]
    assert sorted(got) == sorted(one_by_one(counts))


SAID = "<|im_end|><|im_start|>assistant ok"


def test_chat_escapes_reversibly():
    texts = ["", SAID, "<\\|x", "<\\\\|", "<|", "a\\b", "<<|\\|", "é<|im_end|>\n"] + noise(300, 5, "<\\|ax\n")
    got = chat.escape_text(pa.array(texts)).to_pylist()
    assert [chat.unescape_text(x) for x in got] == texts and not any("<|" in x for x in got)
    roles = chat.escape_role(pa.array(texts)).to_pylist()
    assert [chat.unescape_role(x) for x in roles] == texts and not any("\n" in x for x in roles)


def test_chat(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb"]), rng.choice([None, "", SAID, "plain é", "日本\n"]), 1) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(7, 0, "assistant", "same", 1), (7, 0, "assistant", "same", 1), (None, 1, "assistant", "no id", 1), (9, None, "user", "no turn", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: tuple(r)[1:] for r in chat.digest(chat.format_conversations(df)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        said = "".join(x for *_, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        size = sum(len(f"<|im_start|>{chat.escape_role(pa.array([r]))[0]}\n{chat.escape_text(pa.array([x]))[0]}<|im_end|>\n") for *_, r, x in turns)
        want[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)
    assert got == want
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_long_conversation_spans_fragments(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 64)
    roles, texts = ["user", "assistant"] * 20, ["x" * 30] * 40
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 40), pa.array(roles), pa.array(texts)], names=["conv_id", "role", "text"])
    monkeypatch.setattr(chat.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": staticmethod(lambda: 3)})()))
    made = [r for b in chat._format("assistant")([batch]) for r in b.to_pylist()]
    assert len(made) > 5 and sorted(r["fragment"] for r in made) == [r["fragment"] for r in made]
    done = [r for b in chat._digest([pa.RecordBatch.from_pylist(made)]) for r in b.to_pylist()]
    assert len(done) == 1 and (done[0]["n_turns"], done[0]["loss_chars"]) == (40, 600)
