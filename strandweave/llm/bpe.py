"""Public tokenizers over whole columns, encoding each distinct chunk of a slice once.

A text may be cut where no token can span the cut and nothing on one side changes the
tokens of the other; its parts are encoded alone and the ids put together.  Natural text
repeats its words, so the library sees few of them.  Each kind of tokenizer has its own
cuts; a file of another kind is noticed and its texts are encoded whole.  The bytes of the
ids found are compared with the text, and a text that differs is encoded whole, too.
"""

from __future__ import annotations

import json

import numpy as np

from .bytewords import hash_spans, text_bytes

#: Bytes after which a cut before a space is safe in a byte-level BPE: printable ASCII.
#: After a two-byte letter of the Latin-1 block it is safe too; elsewhere no cut is made.
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = _GRAPH & ~_LETTER
_PUNCT[48:58] = False
_SAME = np.arange(256, dtype=np.uint8)
#: Chunks kept between slices.  Only a speed matter: what is not kept is encoded again.
KEEP = 1_000_000
#: Chunks in one call's text.
JOIN = 1000
#: Ids whose bytes are compared with the text at once.
COMPARED = 1 << 16
#: Text that a piece model leaves as it is only if it does not normalise.
_PROBE = "ﬁ ① Å Ａ é x  y"

_state: dict[tuple, "Encoder"] = {}


def encoder(path: str, control: bool = False) -> "Encoder":
    """One encoder a worker process, vocabulary and reading of control strings."""
    if (path, control) not in _state:
        _state[path, control] = PieceEncoder(path) if path.endswith(".model") else ByteEncoder(path, control)
    return _state[path, control]


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [b for r in (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)) for b in r]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Chunks of texts to ids, remembered by hash; the subclasses know where to cut and how to encode."""

    #: Whether texts may be cut at all.
    cuts = True

    def _setup(self, tokens: list[bytes]) -> None:
        self.vocab_size = len(tokens)
        self.n_bytes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._token_at = np.cumsum(self.n_bytes) - self.n_bytes
        self._token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16 if self.vocab_size <= 65536 else np.uint32)

    def _whole(self, text: bytes) -> list[int]:
        raise NotImplementedError

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order in which the chunks were encoded, their ids one after another, and how many each has."""
        raise NotImplementedError

    def _cut(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Flags of the places before which texts may be cut."""
        raise NotImplementedError

    def _apart(self, data: bytes, off: np.ndarray) -> np.ndarray:
        """Texts that must be encoded whole."""
        return np.zeros(0, np.int64)

    def _learn(self, chunks: list[bytes], hashes: np.ndarray) -> None:
        order, ids, length = self._chunks(chunks)
        start = np.cumsum(length) - length + len(self.ids)
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        h = np.concatenate([self.hash, hashes[order]])
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.start = np.concatenate([self.start, start])[order]
        self.length = np.concatenate([self.length, length])[order]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The ids' bytes, joined."""
        size = self.n_bytes[ids]
        to = np.cumsum(size)
        index = np.arange(int(to[-1]) if len(to) else 0, dtype=np.int64)
        index += np.repeat(self._token_at[ids] - (to - size), size)
        return self._token_bytes[index]

    def spells(self, ids: np.ndarray, at: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether the bytes of each text's ids are the text."""
        ends = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        good = np.diff(ends[at]) == np.diff(off)
        if good.all() and ends[-1] == len(raw):
            parts = range(0, len(ids), COMPARED)
            if all(np.array_equal(self.bytes_of(ids[a : a + COMPARED]), raw[ends[a] : ends[min(a + COMPARED, len(ids))]]) for a in parts):
                return good
        for i in np.flatnonzero(good).tolist():
            good[i] = np.array_equal(self.bytes_of(ids[at[i] : at[i + 1]]), raw[off[i] : off[i + 1]])
        return good

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin."""
        n = len(raw)
        if n == 0:
            return self.ids[:0], np.zeros(len(off), np.int64)
        data = raw.tobytes()
        if self.cuts:
            ids, at = self._by_chunks(raw, off, data)
            apart = np.union1d(self._apart(data, off), np.flatnonzero(~self.spells(ids, at, raw, off)))
        else:
            ids, at, apart = self.ids[:0], np.zeros(len(off), np.int64), np.arange(len(off) - 1)
        if len(apart):
            parts = {i: np.array(self._whole(data[off[i] : off[i + 1]]), self.ids.dtype) for i in apart.tolist()}
            parts = [parts[i] if i in parts else ids[at[i] : at[i + 1]] for i in range(len(off) - 1)]
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, at

    def _by_chunks(self, raw: np.ndarray, off: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        cut = self._cut(raw, off)
        cut[off[:-1][off[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        h = hash_spans(raw, starts, ends, _SAME)
        # the same bytes may begin a text or stand inside; the chunk's ids are the same
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > KEEP:
            self._clear()
        at = np.searchsorted(self.hash, distinct)
        at[at == len(self.hash)] = 0
        new = np.flatnonzero(self.hash[at] != distinct) if len(self.hash) else np.arange(len(distinct))
        if len(new):
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn([data[a:b] for a, b in zip(s, e, strict=True)], distinct[new])
            at = np.searchsorted(self.hash, distinct)
        src, length = self.start[at][which], self.length[at][which]
        to = np.cumsum(length)
        index = np.arange(int(to[-1]), dtype=np.int64)
        index += np.repeat(src - (to - length), length)
        return self.ids[index], np.concatenate([[0], to])[np.searchsorted(starts, off)]


class ByteEncoder(Encoder):
    """Byte-level BPE of the tokenizers library.

    Its pre-tokenizer scans from left to right, and some places always end a token,
    whatever stands around them: before a space after a visible character, before ASCII
    punctuation after a letter, and around a single line feed between visible characters.
    Control strings in texts become their ids, as the library has it, or plain text
    (``control`` false).
    """

    def __init__(self, path: str, control: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made_of = json.loads(self.tokenizer.to_str())
        before = made_of["pre_tokenizer"] or {}
        self.cuts = before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space") and made_of["normalizer"] is None
        special = [t for t in made_of["added_tokens"] if not (t["special"] and not control)]
        self._control, self._strings = control, [t["content"].encode() for t in special]
        self.tokenizer.encode_special_tokens = True
        letters, added = _byte_letters(), {t["id"] for t in made_of["added_tokens"]}
        by_id = {i: t for t, i in self.tokenizer.get_vocab().items()}
        tokens = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self._setup([bytes(letters[c] for c in t) if self.cuts and i not in added else t.encode() for i, t in enumerate(tokens)])

    def _apart(self, data: bytes, off: np.ndarray) -> np.ndarray:
        places = []
        for s in self._strings:
            at = data.find(s)
            while at >= 0:
                places.append(at)
                at = data.find(s, at + 1)
        return np.unique(np.searchsorted(off, places, "right") - 1) if places else np.zeros(0, np.int64)

    def _whole(self, text: bytes) -> list[int]:
        self.tokenizer.encode_special_tokens = not self._control
        try:
            return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        finally:
            self.tokenizer.encode_special_tokens = True

    def _cut(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(raw), bool)
        before, here = raw[:-1], raw[1:]
        seen = _GRAPH[raw]
        safe = seen[:-1].copy()
        safe[1:] |= (raw[1:-1] >= 0x80) & (raw[:-2] == 0xC3)
        cut[1:] = (here == 0x20) & safe | _LETTER[before] & _PUNCT[here]
        feed = np.flatnonzero(here[:-1] == 0x0A) + 1
        feed = feed[seen[feed - 1] & seen[feed + 1]]
        cut[feed] = cut[feed + 1] = True
        return cut

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Plain chunks are joined by line feeds, the others encoded alone."""
        plain = [bool(_GRAPH[c[-1]] and (_GRAPH[c[0]] or (c[0] == 0x20 and len(c) > 1 and _GRAPH[c[1]]))) for c in chunks]
        order = np.argsort(~np.array(plain), kind="stable")
        n_plain = sum(plain)
        chunks = [chunks[i] for i in order.tolist()]
        texts = [b"\n".join(chunks[i : min(i + JOIN, n_plain)]).decode("utf-8", "replace") for i in range(0, n_plain, JOIN)]
        texts += [c.decode("utf-8", "replace") for c in chunks[n_plain:]]
        flat, lengths = [self.ids[:0]], []
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, self.ids.dtype)
            if k * JOIN < n_plain:
                part = chunks[k * JOIN : min(k * JOIN + JOIN, n_plain)]
                ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
                places = np.cumsum(self.n_bytes[ids])
                stop = np.searchsorted(places, ends, "left") + 1  # ids up to the chunk's last byte
                begin = np.append(0, stop[:-1] + 1)  # past the line feed
                keep = np.ones(len(ids), bool)
                keep[stop[:-1]] = False
                ids = ids[keep]
                lengths.append(stop - begin)
            else:
                lengths.append(np.array([len(ids)]))
            flat.append(ids)
        return order, np.concatenate(flat), np.concatenate(lengths)


class PieceEncoder(Encoder):
    """BPE pieces with byte fallback of the sentencepiece library, on texts that begin with a space.

    The library puts that space itself.  Where no piece holds a space after another
    character, nothing joins what stands before such a space with what stands behind.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and m.decode(m.encode(_PROBE)) == _PROBE
        self._setup([bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def _whole(self, text: bytes) -> list[int]:
        return self.model.encode(text[1:].decode("utf-8", "replace"))

    def _cut(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(raw), bool)
        cut[1:] = (raw[1:] == 0x20) & (raw[:-1] != 0x20)
        cut[3:] &= ~((raw[2:-1] == 0x81) & (raw[1:-2] == 0x96) & (raw[:-3] == 0xE2))  # the model's own space sign
        cut[off[1:][off[1:] > 0] - 1] = False  # the library gives nothing for a last space alone
        return cut

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self.model.encode([c[1:].decode("utf-8", "replace") for c in chunks], num_threads=1)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.arange(len(chunks)), np.fromiter((i for x in ids for i in x), self.ids.dtype, int(length.sum())), length


def slices(raw: np.ndarray, off: np.ndarray, limit: int):
    """(first row, last row) of slices of about ``limit`` bytes; a longer text stands alone."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, last
        first = last


def encode_column(column, path: str, limit: int = 4 << 20, control: bool = True):
    """(first row, ids, where each text's ids begin) by slices of a string column; control strings as the library has them."""
    coder = encoder(path, control)
    raw, off = text_bytes(column)
    for first, last in slices(raw, off, limit):
        ids, at = coder.encode(raw[off[first] : off[last]], off[first : last + 1] - off[first])
        yield first, ids, at
