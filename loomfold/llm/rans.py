"""Static range asymmetric numeral coding of token ids, vectorised over lanes.

One frequency table, summing to ``2**SCALE``, serves all blocks. Within a block
token i belongs to lane ``i % LANES``; the lanes are independent coders whose
32-bit words are interleaved in one stream in the order in which a decoder
needs them. Every ``EVERY`` steps a checkpoint keeps the lanes' states and the
stream's place, so that the parts between checkpoints decode independently; the
decoder here takes them all at once. Checksums cover the words and the ids. No ids give no words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE = 20
LANES = 512
EVERY = 128
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64((1 << SCALE) - 1)


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``2**SCALE``, at least 1 for every id that occurs."""
    total, room = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > room // 2:
        raise ValueError("more distinct ids than the table has room for")
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * room // total), 0).astype(np.int64)
    while (extra := int(f.sum()) - room) != 0:
        if extra < 0:
            f[np.argmax(counts)] -= extra
        else:
            large = np.argsort(-f, kind="stable")[: max(1, min(extra, np.count_nonzero(f > 1)))]
            f[large[f[large] > 1]] -= 1
    return f.astype(np.uint32)


@dataclass
class Coder:
    frequency: np.ndarray

    def __post_init__(self) -> None:
        self.f = self.frequency.astype(np.uint64)
        self.start = (np.cumsum(self.f) - self.f).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.frequency)

    def encode(self, ids: np.ndarray) -> dict[str, bytes]:
        """words, states and places (by checkpoint) of a block."""
        n = len(ids)
        steps = -(-n // LANES)
        f, start = self.f[ids], self.start[ids]
        x = np.full(LANES, _LOW, np.uint64)
        ceiling = f << np.uint64(63 - SCALE)
        shift = np.uint64(SCALE)
        words: list[np.ndarray] = []
        states: list[bytes] = []
        for t in range(steps - 1, -1, -1):
            a, b = t * LANES, min(n, t * LANES + LANES)
            y = x[: b - a]
            over = y >= ceiling[a:b]
            words.append(y[over].astype(np.uint32))
            y[over] >>= _WORD
            q = y // f[a:b]
            x[: b - a] = (q << shift) + (y - q * f[a:b]) + start[a:b]
            if t % EVERY == 0:
                states.append(x.astype("<u8").tobytes())
        words.reverse()
        places = np.concatenate([[0], np.cumsum([len(w) for w in words])])[: steps or 1 : EVERY]
        stream = (np.concatenate(words) if words else np.zeros(0, np.uint32)).astype("<u4").tobytes()
        return {"words": stream, "states": b"".join(reversed(states)), "places": places.astype("<u4").tobytes()}

    def decode(self, n: int, words: bytes, states: bytes, places: bytes) -> np.ndarray:
        """Ids of a block, all parts between checkpoints side by side."""
        stream = np.append(np.frombuffer(words, "<u4").astype(np.uint64), np.uint64(0))
        x = np.frombuffer(states, "<u8").astype(np.uint64).reshape(-1, LANES)
        at = np.frombuffer(places, "<u4").astype(np.int64)[: len(x)].copy()
        parts, span = len(x), LANES * EVERY
        out = np.zeros((parts, EVERY, LANES), np.uint32)
        shift = np.uint64(SCALE)
        for t in range(min(EVERY, -(-n // LANES))):
            slot = x & _MASK
            symbol = self.symbol[slot]
            out[:, t] = symbol
            y = self.f[symbol] * (x >> shift) + slot - self.start[symbol]
            # lanes beyond the block's end stay as they are; only the last part has any
            left = n - (parts - 1) * span - t * LANES
            if left < LANES:
                y[-1, max(0, left) :] = x[-1, max(0, left) :]
            need = y < _LOW
            order = np.cumsum(need, axis=1)
            if order[:, -1].any():
                r, c = np.nonzero(need)
                y[r, c] = (y[r, c] << _WORD) | stream[at[r] + order[r, c] - 1]
                at += order[:, -1]
            x = y
        return out.reshape(-1)[:n]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
