"""Cached encoding with a tokenizer file of the ``tokenizers`` library.

Running text repeats its words, and a pre-tokenizer never merges across the
parts that it cuts a text into.  Texts are therefore cut by its pattern, each
distinct part is encoded once per worker by the library's own model, and a
document is the concatenation of its parts' ids.  Texts in which a cut is not
proven safe (other than Latin letters of one code point, or with a control
string of the vocabulary) go to the library whole or between spaces, so ids
always equal a direct encoding.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Pieces and parts kept per worker; a full cache starts afresh.
CACHE_PIECES, CACHE_PARTS = 100_000, 450_000
#: Parts are encoded in texts of about so many.
JOIN = 500

# Latin letters that have no canonical decomposition partner in this set, so
# that normalisation and lower-casing act on each of them alone.
_SAFE_SPACED = re.compile(r"[\x09\x0a\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]+")
# The pre-tokenizers' patterns, with the letters and digits of such texts spelt out.
_WORD_PARTS = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_BYTE_PARTS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as ``encode(text, add_special_tokens=False)`` does.

    Two kinds of vocabulary are known by their normaliser: one that lower-cases
    and drops white space, and a byte-level one in which a space joins the word
    after it.  A control string of the vocabulary inside a text gets its control
    id, as the library has it; with ``ordinary`` it is ordinary text.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = ordinary
        self.word = self.tok.normalizer is not None
        self.controls = [] if ordinary else [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.find = (_WORD_PARTS if self.word else _BYTE_PARTS).findall
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # Words of letters go to the model in its own alphabet, one character for each byte; nothing is left to normalise or cut.
        self.model = Tokenizer.from_file(path)
        self.model.normalizer, self.model.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in kept]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}
        # Where a word begins or ends shows in its tokens.
        self.edge = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.edge[i] = token.endswith("</w>") if self.word else token.startswith("Ġ")

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _spelt(self, word: str) -> str:
        return word.replace(" ", "Ġ") if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)

    def _learn(self, new: list[str]) -> None:
        plain, other = [], []
        for x in new:
            (plain if (x if self.word else x[1:]).isalpha() and (self.word or x[0] == " ") else other).append(x)
        groups = [plain[i : i + JOIN] for i in range(0, len(plain), JOIN)]
        for g, e in zip(groups, self.model.encode_batch_fast([" ".join(map(self._spelt, g)) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(self.edge[ids])
            cuts = [0, *(at + 1).tolist()] if self.word else [*at.tolist(), len(ids)]
            if len(cuts) == len(g) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                raw = ids.tobytes()
                for x, i, j in zip(g, cuts, cuts[1:], strict=False):
                    self.parts[x] = raw[4 * i : 4 * j]
            else:
                other += g
        for x, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.parts[x] = self._pack(e.ids)

    def _between_spaces(self, text: str) -> bytes:
        """A text with other letters: of pieces between spaces, those that repeat are encoded once."""
        if self.word:
            # split() also cuts at four control characters that are no white space to the library.
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return self.whole(text)
            cut = text.split()
        else:
            first, *rest = text.split(" ")
            if any(not x or x[0].isspace() for x in rest):
                return self.whole(text)
            cut = [first] * bool(first) + [" " + x for x in rest]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        out = []
        for x in cut:
            if (ids := self.pieces.get(x)) is None:
                ids = self.pieces[x] = self.whole(x)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; None: as empty."""
        cut: list[list[str] | bytes] = []
        wanted: set[str] = set()
        for t in texts:
            low = t.lower() if t else ""
            if not t:
                cut.append(b"")
            elif any(c in low for c in self.controls):
                cut.append(self.whole(t))
            elif _SAFE_SPACED.fullmatch(t):
                parts = self.find(low if self.word else t)
                wanted.update(parts)
                cut.append(parts)
            else:
                cut.append(self._between_spaces(t))
        if len(self.parts) + len(wanted) > CACHE_PARTS:
            self.parts.clear()
        if new := wanted.difference(self.parts):
            self._learn(list(new))
        get = self.parts.__getitem__
        return [c if isinstance(c, bytes) else b"".join(map(get, c)) for c in cut]


@lru_cache(maxsize=4)
def encoder(path: str, ordinary: bool = False) -> Encoder:
    """The worker's encoder of a file; kept from task to task."""
    return Encoder(path, ordinary)
