"""Exact, fast use of a public tokenizer file: texts are cut at boundaries that its pre-tokenizer
never crosses, and each distinct piece is encoded by the library once per Python worker.

A cut is made before a space or line feed that follows a visible ASCII character or a Latin-1
letter, and between a letter and a following ASCII punctuation mark or digit. In both pre-tokenizers
known here (the byte-level pattern, and the pattern of letters, single digits and marks) every match
ends there, no look-ahead reaches over it, and the normaliser changes nothing across it. Texts that
hold one of the file's special strings, and those of files not known here, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat

#: Classes of bytes: 0 none, 1 space or line feed, 2 letter, 3 other visible ASCII, 4 lead of Latin-1 letters.
_STRICT = bytearray(256)
for _c in range(0x21, 0x7F):
    _STRICT[_c] = 2 if chr(_c).isalpha() else 3
_STRICT[0x20] = _STRICT[0x0A] = 1
#: In texts whose only lead byte is 0xC3, each other byte over 0x7F ends a letter, but for the two signs.
_LATIN = bytearray(_STRICT)
for _c in range(0x80, 0xC0):
    _LATIN[_c] = 0 if _c in (0x97, 0xB7) else 2
_STRICT, _LATIN = bytes(_STRICT), bytes(_LATIN)
_CUT = bytearray(256)
_CUT[(2 << 3) | 1] = _CUT[(3 << 3) | 1] = _CUT[(2 << 3) | 3] = 1
_CUT = bytes(_CUT)
#: Bytes of texts for which _LATIN holds.
_PLAIN = bytes([*range(0x80), *range(0x80, 0xC0), 0xC3])

_KNOWN_PATTERNS = {
    "ByteLevel",
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def _known(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0]
    pattern = (first.get("pattern") or {}).get("Regex", first.get("type"))
    ok = pattern in _KNOWN_PATTERNS and (first.get("type") != "ByteLevel" or first.get("use_regex", True) and not first.get("add_prefix_space"))
    norm = spec.get("normalizer") or {"normalizers": []}
    allowed = {"NFC", "Replace", "Lowercase"}
    return ok and all(n["type"] in allowed for n in norm.get("normalizers", [norm]))


class Encoder:
    """Ids or counts of whole texts, as the library gives them without added special tokens.

    keep_ids: else only lengths are kept. most: distinct pieces held at most; beyond it those met in one batch
    only are forgotten, and all if that leaves too many.
    """

    def __init__(self, file: str, keep_ids: bool, most: int = 500_000, window: int = 2 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.keep_ids, self.most, self.window = keep_ids, most, window
        self.sentencepiece = file.endswith(".model")
        if self.sentencepiece:
            import sentencepiece

            self.tok, self.known, self.special = sentencepiece.SentencePieceProcessor(model_file=file), False, []
        else:
            from tokenizers import Tokenizer

            with open(file, encoding="utf-8") as f:
                text = f.read()
            spec = json.loads(text)
            self.tok = Tokenizer.from_str(text)
            self.tok.no_truncation()
            self.tok.no_padding()
            self.known = _known(spec)
            self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self._clear()

    def _clear(self) -> None:
        self.store = pa.array([], pa.large_binary())  # the pieces known; their places are those of the arrays below
        self.n = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.met = np.zeros(0, np.uint8)  # batches that held the piece, 2 at most

    def _forget(self) -> None:
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > self.most // 2:
            return self._clear()
        n, begin = self.n[keep].astype(np.int64), self.begin[keep]
        ends = np.cumsum(n)
        if self.keep_ids:
            self.ids = self.ids[np.repeat(begin - (ends - n), n) + np.arange(n.sum())]
        self.n, self.begin, self.met = self.n[keep], ends - n, np.full(len(keep), 2, np.uint8)
        self.store = self.store.take(pa.array(keep))

    def _add(self, new: pa.Array) -> None:
        """Encodes pieces not seen before."""
        counts, ids = [self.n], [self.ids]
        for i in range(0, len(new), 10_000):
            part = new.slice(i, 10_000).cast(pa.large_string()).to_pylist()
            e = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            counts.append(np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(part)).astype(np.int32) if len(e.ids) else np.zeros(len(part), np.int32))
            if self.keep_ids:
                ids.append(np.asarray(e.ids, np.uint32))
        self.n = np.concatenate(counts)
        if self.keep_ids:
            self.ids = np.concatenate(ids)
            self.begin = np.cumsum(self.n, dtype=np.int64) - self.n
        else:
            self.begin = np.zeros(len(self.n), np.int64)
        self.met = np.append(self.met, np.zeros(len(new), np.uint8))
        self.store = pa.concat_arrays([self.store, new])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        if self.sentencepiece:
            return [np.asarray(x, np.uint32) for x in self.tok.encode(texts, num_threads=1)]
        return [np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray] | None]:
        """Tokens of each text, and its ids if kept. Null counts as empty."""
        buf, off = flat(texts)
        raw, n = buf.tobytes(), len(off) - 1
        view = lambda i: raw[off[i] : off[i + 1]]
        whole = np.zeros(n, bool)
        if not self.known:
            whole[:] = True
        elif any(s in raw for s in self.special):
            whole[:] = [any(s in view(i) for s in self.special) for i in range(n)]
        strict = np.zeros(n, bool)
        if raw.translate(None, _PLAIN):
            strict[:] = [bool(view(i).translate(None, _PLAIN)) for i in range(n)]
        counts = np.zeros(n, np.int64)
        ids: list[np.ndarray] | None = [np.empty(0, np.uint32)] * n if self.keep_ids else None
        for rows, classes in ((np.flatnonzero(~whole & ~strict), _LATIN), (np.flatnonzero(~whole & strict), _STRICT)):
            if not len(rows):
                continue
            if len(rows) == n:
                part, at = raw, off
            else:
                part, at = b"".join(view(i) for i in rows), np.concatenate([[0], np.cumsum(off[rows + 1] - off[rows])])
            got, flat_ids = self._pieces(part, at, classes)
            counts[rows] = got
            if ids is not None:
                ends = np.cumsum(got)
                for i, a, b in zip(rows.tolist(), (ends - got).tolist(), ends.tolist()):
                    ids[i] = flat_ids[a:b]
        rows = np.flatnonzero(whole)
        for i, x in zip(rows.tolist(), self._whole([view(i).decode() for i in rows]) if len(rows) else []):
            counts[i] = len(x)
            if ids is not None:
                ids[i] = x
        return counts, ids

    def _pieces(self, raw: bytes, off: np.ndarray, classes: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Counts by text and all ids in order, window by window; a window ends at a cut."""
        total, lo, size, counts, out = len(raw), 0, self.window, np.zeros(len(off) - 1, np.int64), []
        while lo < total:
            hi = min(total, lo + size)
            kinds = np.frombuffer(raw[lo:hi].translate(classes), np.uint8)
            pairs = ((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(_CUT)
            cut = np.zeros(hi - lo + 1, bool)
            cut[1:-1] = np.frombuffer(pairs, np.bool_)
            a, b = np.searchsorted(off, (lo, hi))
            cut[off[a:b] - lo] = True
            cut[0], cut[-1] = True, hi == total
            bounds = np.flatnonzero(cut)
            if len(bounds) < 2:
                size *= 2  # no safe boundary in the window: it grows
                continue
            size = self.window
            pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw[lo:hi])])
            coded = pieces.dictionary_encode()
            if len(self.store) > self.most:
                self._forget()
            known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.store), -1).to_numpy().copy()
            miss = np.flatnonzero(known < 0)
            if len(miss):
                known[miss] = np.arange(len(self.store), len(self.store) + len(miss))
                self._add(coded.dictionary.take(pa.array(miss)))
            self.met[known] = np.minimum(self.met[known] + 1, 2)
            g = known[coded.indices.to_numpy()]
            n = self.n[g]
            # ids of the pieces of each text, by running sums at the texts' ends
            sums = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            first = np.searchsorted(bounds, off[a:b] - lo)
            inner = np.concatenate([[0], first, [len(n)]])
            counts[max(0, a - 1) : b] += np.diff(sums[inner])[(0 if a else 1) : b - a + 1]
            if self.keep_ids:
                where = np.arange(sums[-1], dtype=np.int64 if sums[-1] + len(self.ids) >> 31 else np.int32)
                where += np.repeat((self.begin[g] - sums[:-1]).astype(where.dtype), n)
                out.append(self.ids[where])
            lo += int(bounds[-1])
        return counts, np.concatenate(out) if out else np.empty(0, np.uint32)


_encoders: dict[tuple, Encoder] = {}


def encoder(file: str, keep_ids: bool) -> Encoder:
    """One per Python worker, file and use."""
    return _encoders.get((file, keep_ids)) or _encoders.setdefault((file, keep_ids), Encoder(file, keep_ids))


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
