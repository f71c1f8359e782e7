"""Token-piece boundaries of the byte-level BPE pattern without a regular expression.

Code points map to classes, each class is a function on the states of a small automaton, functions compose
associatively, and a blocked scan of those compositions gives the state before every code point.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, GLUE, LONE, RUN, SHORT, LONG = range(8)
IN_LETTER, IN_NUMBER, IN_OTHER, GLUED, IN_RUN, CLOSED, ONE_MORE, TWO_MORE = range(8)
# Unicode White_Space.
SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    kinds = "".join(unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1))
    kind = np.frombuffer(kinds.encode(), np.uint8)
    out = np.full(len(kind), OTHER, np.uint8)
    out[kind == ord("L")] = LETTER
    out[kind == ord("N")] = NUMBER
    out[SPACES] = RUN
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return CLOSED, False
    if symbol in (LETTER, NUMBER, OTHER):
        return symbol, state not in (symbol, GLUED)
    if symbol in (SHORT, LONG):
        if state in (IN_OTHER, GLUED):
            return IN_OTHER, False
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == RUN:
        return IN_RUN, state != IN_RUN
    return (GLUED if symbol == GLUE else CLOSED), True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol (8 to 15: the same at a text's start), compositions, values, and starts[state, symbol]."""
    base = [tuple(_step(CLOSED if s > 7 else q, s % 8)[0] for q in range(8)) for s in range(16)]
    index = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *base]))}
    todo = list(index)
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[q] for q in f)
            if h not in index:
                index[h] = len(index)
                todo.append(h)
    fs = list(index)
    compose = np.array([[index.get(tuple(g[q] for q in f), 0) for g in fs] for f in fs], np.uint16)
    starts = np.array([[_step(CLOSED if s > 7 else q, s % 8)[1] for s in range(16)] for q in range(8)])
    return np.array([index[f] for f in base], np.uint16), compose, np.array(fs, np.uint8), starts


def _scan(f: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions."""
    n = len(f)
    if n <= 64:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], f[i]]
        return out
    blocks = max(1, int(n**0.5) * 4)
    width = -(-n // blocks)
    padded = np.zeros(blocks * width, f.dtype)
    padded[:n] = f
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    flat, m = compose.ravel(), compose.shape[1]
    for j in range(1, width):
        grid[j] = flat[grid[j - 1].astype(np.intp) * m + grid[j]]
    before = np.zeros(blocks, f.dtype)
    before[1:] = _scan(grid[-1], compose)[:-1]
    return flat[before.astype(np.intp)[None, :] * m + grid].T.ravel()[:n]


def boundaries(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions in `code` (code points of texts laid end to end) at which a piece starts; first: starts of non-empty texts."""
    if not len(code):
        return np.zeros(0, np.int64)
    symbol = classes()[code]
    at_first = np.zeros(len(code) + 1, bool)
    at_first[first] = at_first[-1] = True
    space = symbol == RUN
    followed = np.zeros(len(code), bool)
    followed[:-1] = ~space[1:]
    followed &= ~at_first[1:]
    last = space & followed
    symbol[last] = np.where(code[last] == 0x20, GLUE, LONE)
    quote = np.flatnonzero(code == 0x27)
    if len(quote):
        ahead = np.concatenate([code, np.zeros(2, code.dtype)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        inside = ~at_first[quote + 1]
        second = inside & ~at_first[np.minimum(quote + 2, len(code))]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[quote[short]] = SHORT
        symbol[quote[second & pairs]] = LONG
    symbol[first] += 8
    functions, compose, values, starts = automaton()
    states = values[_scan(functions[symbol], compose), CLOSED]
    before = np.empty_like(states)
    before[0], before[1:] = CLOSED, states[:-1]
    return np.flatnonzero(starts[before, symbol])


def pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes laid end to end, byte offsets of pieces (with the end), and each text's first piece (with the end)."""
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([0, *map(len, texts)])
    start = boundaries(code, ends[:-1][np.diff(ends) > 0])
    width = np.ones(len(code) + 1, np.int64)
    for low in (0x80, 0x800, 0x10000):
        width[:-1] += code >= low
    at = np.zeros(len(code) + 1, np.int64)
    np.cumsum(width[:-1], out=at[1:])
    return joined.encode(), at[np.append(start, len(code))], np.searchsorted(start, ends)
