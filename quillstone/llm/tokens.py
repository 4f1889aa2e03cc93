"""Ids of the public tokenizers, piece by piece with a cache.

The library gives every id. A text of ordinary characters is cut into the tokenizer's own pieces and each distinct piece
is encoded once while it is remembered; any other text goes to the library whole. Both ways give the same ids (tests
compare them).
"""

from __future__ import annotations

import array
import json
import os
import re
from itertools import chain

import numpy as np

#: Characters whose class, case and normal form agree between the library and Python: ASCII text and Latin-1 letters and signs.
_ORDINARY = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
# Letters and numbers among them, as \p{L} and \p{N} have it.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Distinct pieces of a generation of the cache. Two are held; what the older one still serves moves to the newer.
CACHE_PIECES = 200_000
#: Words that go to the library as one text.
JOINED = 2000


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cut, self.word, self.lower, self.gap = self._rule()
        self.ends = self._ends()

    def _rule(self):
        """The tokenizer's own split rule, read from its file: how a text is cut, which pieces may stand side by side, lower case, what joins them."""
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = pre.get("pretokenizers") or []
        kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            cut = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
            return re.compile(cut).findall, re.compile(rf" [{_L}]+").fullmatch, False, ""
        words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if len(steps) == 2 and steps[0].get("pattern") == {"Regex": words} and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and kinds == ["NFC", "Replace", "Lowercase"]:
            cut = rf"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^\s{_L}{_N}]+"
            return re.compile(cut).findall, re.compile(rf"[{_L}]+").fullmatch, True, " "
        return None, None, False, ""

    def _ends(self) -> np.ndarray:
        """By id: whether a token ends a word, or (where words begin with their space) begins one."""
        said = sorted((i, t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items())
        flags = np.zeros(said[-1][0] + 1, dtype=bool)
        flags[[i for i, t in said if (t.endswith("</w>") if self.gap else t.startswith("\u0120"))]] = True
        return flags

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, unknown: list[str]) -> dict[str, bytes]:
        """Ids of pieces: plain words side by side in one text, told apart by the tokens that end or begin words; others one by one."""
        found, plain = {}, [p for p in unknown if self.word(p)]
        for at in range(0, len(plain), JOINED):
            words = plain[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([self.gap.join(words)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1 if self.gap else np.append(np.flatnonzero(self.ends[ids])[1:], len(ids))
            if len(last) == len(words) and last[-1] == len(ids):
                raw, stop = ids.tobytes(), (4 * last).tolist()
                found.update((w, raw[a:b]) for w, a, b in zip(words, [0, *stop[:-1]], stop, strict=True))
        rest = [p for p in unknown if p not in found]
        found.update(zip(rest, self._library(rest), strict=True))
        return found

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as native unsigned 32-bit integers; null is an empty text."""
        out: list[bytes | None] = [None] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if not isinstance(text, str) or not text:
                out[i] = b""
            elif self.cut and _ORDINARY.fullmatch(text):
                cut.append((i, self.cut(text.lower() if self.lower else text)))
            else:
                out[i] = self._library([text])[0]
        if len(self.cache) > CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        new = set(chain.from_iterable(pieces for _, pieces in cut)).difference(self.cache)
        known = {p: self.older[p] for p in new if p in self.older}
        self.cache |= known
        self.cache |= self._pieces([p for p in new if p not in known])
        for i, pieces in cut:
            out[i] = b"".join(map(self.cache.__getitem__, pieces))
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
