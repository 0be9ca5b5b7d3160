"""Simple-8b: integers in 64-bit words, as many of equal width in a word as fit.

The top four bits of a word are its selector, which says how many values of how many
bits follow. A value of more than 60 bits is escaped: a word with the escape selector,
then the value as a word of its own. Blocks of ``BLOCK`` values start on a word, so
blocks are packed and unpacked side by side with numpy instead of one after the other.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024

# --- fixed values: selector -> values in a word, bits of each. 0: escape; 1: zeros ---
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
# --- end of fixed values ---
ESCAPE = 0
_PAYLOAD = (1 << 60) - 1


# Selectors from few wide values to many narrow ones. What fits one fits all before it.
_BY_COUNT = range(len(COUNTS) - 1, ESCAPE, -1)


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs; 0 for 0. May be one too many above 2^53."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int8)


def _word_at(widths: np.ndarray, at: np.ndarray, left: np.ndarray):
    """Selector and number of values of the words that start at ``at``.

    ``left``: values up to the end of each block. The last word of a block may hold
    fewer values than its selector allows; behind a block, ``widths`` is 0.
    """
    selector, taken = np.full(len(at), ESCAPE), np.ones(len(at), dtype=np.int64)
    open_, widest, seen = np.arange(len(at)), widths[at], 1
    for s in _BY_COUNT:
        while seen < COUNTS[s]:
            widest = np.maximum(widest, widths[at[open_] + seen])
            seen += 1
        fits = widest <= WIDTHS[s]
        if not fits.all():
            open_, widest = open_[fits], widest[fits]
        want = np.minimum(COUNTS[s], left[open_])
        selector[open_], taken[open_] = s, want
        more = want < left[open_]  # else the block ends with this word
        if not more.all():
            open_, widest = open_[more], widest[more]
        if not len(open_):
            break
    return selector, taken


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the first word of each block."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u4")
    blocks = -(-n // BLOCK)
    stride = BLOCK + int(COUNTS.max())
    widths = np.zeros((blocks, stride), dtype=np.int8)
    padded = np.zeros(blocks * BLOCK, dtype=np.int8)
    padded[:n] = bit_widths(values)
    widths[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    widths = widths.ravel()
    # Every block takes one word at a time, all blocks at once.
    block, at = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    ends = np.minimum(BLOCK, n - block * BLOCK)
    firsts, selectors, counts = [], [], []
    while len(at):
        selector, taken = _word_at(widths, block * stride + at, ends - at)
        firsts.append(block * BLOCK + at)
        selectors.append(selector)
        counts.append(taken)
        at = at + taken
        going = at < ends
        if not going.all():
            block, at, ends = block[going], at[going], ends[going]
    first = np.concatenate(firsts)
    order = np.argsort(first)
    first = first[order]
    chosen, many = np.concatenate(selectors)[order], np.concatenate(counts)[order]
    size = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype="<u8")
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        to, of, has = place[mine], first[mine], many[mine]
        if s == ESCAPE:
            words[to + 1] = values[of]
        for k in range(int(COUNTS[s]) if s > 1 else 0):
            if k:
                some = has > k
                if not some.all():
                    to, of, has = to[some], of[some], has[some]
            words[to] |= values[of + k] << np.uint64(k * int(WIDTHS[s]))
    starts = place[np.searchsorted(first, np.arange(0, n, BLOCK))]
    return words, starts.astype("<u4")


def decode(words: np.ndarray, n: int, offsets: np.ndarray) -> np.ndarray:
    """The ``n`` values; ``offsets`` is the first word of each block."""
    words = np.asarray(words, dtype=np.uint64)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # The word after an escape is a value and has no selector. Its top bits may look like
    # an escape, so a run of such words is read in pairs from where it starts.
    raw = np.zeros(len(words), dtype=bool)
    looks = np.flatnonzero(selector == ESCAPE)
    if len(looks):
        opens_run = np.concatenate(([True], np.diff(looks) > 1))
        opener = looks[np.maximum.accumulate(np.where(opens_run, np.arange(len(looks)), 0))]
        after = looks[(looks - opener) % 2 == 0] + 1
        raw[after[after < len(words)]] = True
    real = np.flatnonzero(~raw)
    chosen = selector[real]
    block = np.searchsorted(offsets, real, side="right") - 1
    room = np.minimum(BLOCK, n - block * BLOCK)
    many = COUNTS[chosen]
    # Values of earlier words in the same block; only a block's last word is not full.
    before = np.cumsum(many) - many
    opens = np.searchsorted(real, offsets)
    before = before - before[opens][block]
    start = block * BLOCK + before
    many = np.minimum(many, room - before)
    out = np.zeros(n, dtype=np.uint64)
    for s in np.unique(chosen).tolist():
        if s == 1:
            continue
        mine = chosen == s
        if s == ESCAPE:
            out[start[mine]] = words[real[mine] + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        word, to, has = words[real[mine]] & np.uint64(_PAYLOAD), start[mine], many[mine]
        for k in range(int(COUNTS[s])):
            some = has > k
            if not some.any():
                break
            out[to[some] + k] = (word[some] >> np.uint64(k * int(WIDTHS[s]))) & mask
    return out
