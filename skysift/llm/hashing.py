"""64-bit hashes of texts' words, for many texts at once."""

from __future__ import annotations

import numpy as np

from skysift.llm.common import SPACES

_rng = np.random.default_rng(20240229)
#: A number for each byte, the same one for A-Z and a-z, and an odd factor for each place in a word.
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_FACTOR = _rng.integers(0, 1 << 63, 1, np.uint64)[0] * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: Bytes hashed at once.
AT_ONCE = 1 << 16
#: Powers of the factor that are kept; longer words make more for themselves.
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, _FACTOR, np.uint64)]), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word; a bijection."""
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ h >> np.uint64(33)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in order, and each text's number of words; null: none.

    Words are runs of other than ASCII white space, with A-Z lower-cased.  A few
    texts are taken at once, as much as stays in a processor's cache.
    """
    out, some, size = [], [], 0
    for t in texts:
        some.append(t.encode() if t else b"")
        size += len(some[-1]) + 1
        if size >= AT_ONCE:
            out.append(_hashed(some))
            some, size = [], 0
    if some or not out:
        out.append(_hashed(some))
    return np.concatenate([h for h, _ in out]), np.concatenate([n for _, n in out])


def _hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw])))
    if not len(starts):
        return np.empty(0, np.uint64), sizes
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1], dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    longest = int(lengths.max())
    with np.errstate(over="ignore"):
        powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _FACTOR, np.uint64)]), dtype=np.uint64)
        sums = np.add.reduceat(_BYTE[data[inside]] * powers[place], first)
        return mixed(sums + lengths.astype(np.uint64) * _LENGTH), sizes


def word_hashes(text: str | None) -> np.ndarray:
    return hashed([text])[0]
