"""Token ids from a public tokenizer file, with a bounded cache of pieces.

The tokenizer splits a text before it merges bytes, and it always splits where white space follows other characters and
before a single space that other characters follow. So a text may be encoded piece by piece, and most pieces of a corpus
are words seen before: each is encoded once and kept, until the cache is full and starts anew.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

END_ID = 0
MAX_CACHED = 600_000
_SPACE = " \t\n\r\f\v"
_OTHER_SPACE = re.compile(r"[^\S\n\0]")
_SIGNS = ".,;:!?*#%&$|()-\"'"
_PIECE = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._bytes = self._byte_level(path)
        self._signs: dict[str, bytes] = {}
        self._newline = int(self._ids("\n")[0])
        self._spaced: dict[str, bytes] = {}
        self._raw: dict[str, bytes] = {}
        self._odd: set[str] = set()
        self._odd_raw: set[str] = set()

    @staticmethod
    def _byte_level(path: str) -> dict[int, str] | None:
        """Characters that stand for bytes in a byte-level BPE file; None for any other kind of tokenizer. Printable Latin-1
        characters stand for themselves, the other bytes for those from U+0100 on, in order."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _learn(self, cache: dict[str, bytes], keys: list[str], texts: list[str]) -> None:
        for key, got in zip(keys, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            cache[key] = np.asarray(got.ids, dtype=self.dtype).tobytes()

    def _learn_letters(self, keys: list[str]) -> list[str]:
        """Learns the keys that are letters with signs after them: the tokenizer splits these in two before it merges
        bytes, so both parts are kept and joined, and letters go to its model without a further split. Returns the rest."""
        if not self._bytes:
            return keys
        rest, spaced, signs, model = [], self._spaced, self._signs, self.tokenizer.model
        for k in keys:
            letters = k.rstrip(_SIGNS)
            if not letters.isalpha():
                rest.append(k)
                continue
            if letters not in spaced:
                text = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self._bytes)
                spaced[letters] = np.array([t.id for t in model.tokenize("\u0120" + text)], dtype=self.dtype).tobytes()
            if len(letters) < len(k):
                after = k[len(letters) :]
                if after not in signs:
                    signs[after] = self._ids(after).tobytes()
                spaced[k] = spaced[letters] + signs[after]
        return rest

    def _learn_words(self, keys: list[str]) -> None:
        """Words without inner white space, in one call: a line end between them is always a token of its own."""
        if not keys:
            return
        ids = self._ids("".join(f"\n {k}" for k in keys))
        at = np.flatnonzero(ids == self._newline)
        if len(at) != len(keys):
            self._learn(self._spaced, keys, [f" {k}" for k in keys])
            return
        width, raw = self.dtype.itemsize, ids.tobytes()
        first, last = ((at + 1) * width).tolist(), [*(at[1:] * width).tolist(), len(raw)]
        self._spaced.update(zip(keys, [raw[a:b] for a, b in zip(first, last)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``."""
        if len(self._spaced) + len(self._raw) > MAX_CACHED:
            self._spaced, self._raw, self._signs, self._odd, self._odd_raw = {}, {}, {}, set(), set()
        plain: list[list[str] | None] = []
        for t in texts:
            usual = t and "  " not in t and "\n\n" not in t and " \n" not in t and "\n " not in t and t[0] not in " \n" and t[-1] not in " \n"
            plain.append(t.replace("\n", " \n").split(" ") if usual else None)
        new = set().union(*(p[1:] for p in plain if p)).difference(self._spaced, self._odd)
        if _OTHER_SPACE.search("\0".join(new)):
            # other white space next to a space or a line end could join with it
            odd = {k for k in new if any(c.isspace() for c in k[k[0] == "\n" :])}
            self._odd |= odd
            new -= odd
        lines = [k for k in new if k[0] == "\n"]
        self._learn(self._spaced, lines, lines)
        self._learn_words(self._learn_letters([k for k in new if k[0] != "\n"]))
        if self._odd:
            plain = [p if p is None or self._odd.isdisjoint(p) else None for p in plain]
        raw = [[p[0]] if p else _PIECE.findall(t) for p, t in zip(plain, texts)]
        new = set().union(*raw).difference(self._raw, self._odd_raw)
        odd = {k for k in new if any(c.isspace() for c in k.lstrip(_SPACE))}  # other scripts' spaces
        self._odd_raw |= odd
        new -= odd
        if self._odd_raw:
            for i, r in enumerate(raw):
                if not self._odd_raw.isdisjoint(r):
                    plain[i], raw[i] = None, None
        self._learn(self._raw, new, list(new))
        spaced, kept = self._spaced.__getitem__, self._raw.__getitem__
        return [
            self._whole(t) if r is None else b"".join(map(kept, r)) + (b"".join(map(spaced, p[1:])) if p else b"")
            for t, p, r in zip(texts, plain, raw)
        ]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


_ready: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ready:
        _ready.clear()
        _ready[path] = Encoder(path)
    return _ready[path]


def groups(texts: list[str], limit: int = 1 << 20):
    """(first, after the last) of runs of texts of about ``limit`` characters."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= limit):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi
