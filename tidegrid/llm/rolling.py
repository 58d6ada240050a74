"""Rolling hashes, minimizers and runs of windows, on numpy arrays inside tasks.

A window is K consecutive symbols.  Each window has an anchor: of its short grams the one with the least hash, the leftmost
of equals.  Consecutive windows with one anchor form a run.  Equal windows have equal anchors at equal places, wherever they
stand, so runs with different anchor hashes share no window.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Symbols that are hashed at once; longer texts are cut into parts that overlap by a window less one symbol.
PART = 4_000_000
PLACE_BITS = 24


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(n, U(base))]))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; ``n`` + 1 values."""
    size = 1 << max(10, n.bit_length())
    return _powers(base, size)[: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash spread over the word."""
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Polynomial hashes (modulo 2**64) of all prefixes; the hash of a span is a difference, scaled by ``span_hashes``."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(BASE, len(symbols))[:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the symbols in [start, end), the same wherever they stand."""
    return (prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts]


def gram_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` symbols."""
    n = len(prefix) - size
    return (prefix[size:] - prefix[:-size]) * powers(INVERSE, len(prefix))[:n] if n > 0 else np.zeros(0, np.uint64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by running minima from both ends of blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def window_runs(symbols: np.ndarray, window: int, gram: int):
    """Runs of the windows of a sequence: arrays (first window, past the last, anchor's place, anchor's hash).

    Sequences of fewer symbols than a window have none.
    """
    first, past, place, key = [], [], [], []
    for at in range(0, max(1, len(symbols) - window + 1), PART):
        part = symbols[at : at + PART + window - 1]
        if len(part) < window:
            break
        grams = mixed(gram_hashes(prefix_hashes(part), gram))
        low = U((1 << PLACE_BITS) - 1)
        least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        anchor = (least & low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(anchor, prepend=-1))
        first.append(cuts + at)
        past.append(np.append(cuts[1:], len(anchor)) + at)
        place.append(anchor[cuts] + at)
        key.append(grams[anchor[cuts]])
    if not first:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in (first, past, place, key))


def byte_symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8).astype(np.uint64) + U(1)


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other bytes than white space)."""
    inside = np.concatenate([[False], ~_SPACES[np.frombuffer(text, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_symbols(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    return mixed(span_hashes(prefix_hashes(byte_symbols(text)), starts, ends) + (ends - starts).astype(np.uint64) * U(0x632BE59BD9B4E019))
