"""Splits texts as the byte-level pattern does, without regular expressions.

Each code point gets a class, each class (with what it must know of the next two
code points) a symbol, and each symbol is a function from automaton state to
automaton state.  Functions compose associatively, and all their compositions
form a small monoid, so the states at all places come from one prefix scan over
monoid elements: columns of a block matrix are scanned side by side and the
blocks' totals are scanned in turn.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

L, N, O, S1, S2, SPACE_IN, SPACE_END, WHITE_IN, WHITE_END = range(9)
SYMBOLS = 9
START, IN_L, IN_N, IN_O, IN_WHITE, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
#: White space as the pattern's \s has it.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
K_LETTER, K_NUMBER, K_OTHER, K_WHITE = range(4)
COLUMN = 256


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, K_OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            table[cp] = K_LETTER
        elif c == "N":
            table[cp] = K_NUMBER
    table[WHITE] = K_WHITE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the token goes on."""
    if symbol == L:
        if state in (IN_L, AFTER_SPACE):
            return IN_L, True
        if state == ONE_LEFT:
            return START, True
        if state == TWO_LEFT:
            return ONE_LEFT, True
        return IN_L, False
    if symbol == N:
        return IN_N, state in (IN_N, AFTER_SPACE)
    if symbol in (O, S1, S2):
        if state in (IN_O, AFTER_SPACE):
            return IN_O, True
        return (IN_O, ONE_LEFT, TWO_LEFT)[symbol - O], False
    if symbol in (SPACE_IN, WHITE_IN):
        return IN_WHITE, state == IN_WHITE
    return (AFTER_SPACE if symbol == SPACE_END else START), False


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol -> element (first-of-text symbols come second), composition, element x state -> state, state x symbol -> goes on."""
    step = [tuple(_step(s, k)[0] for s in range(STATES)) for k in range(SYMBOLS)]
    step += [tuple([step[k][START]] * STATES) for k in range(SYMBOLS)]
    elements = [tuple(range(STATES))]
    index = {elements[0]: 0}
    table: dict[tuple[int, int], int] = {}
    at = 0

    def of(f: tuple[int, ...]) -> int:
        if f not in index:
            index[f] = len(elements)
            elements.append(f)
        return index[f]

    generators = [of(f) for f in step]
    while at < len(elements):  # all products with a generator; the closure is then closed
        for g in generators:
            of(tuple(elements[g][s] for s in elements[at]))
        at += 1
    m = len(elements)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            table[i, j] = index[tuple(g[s] for s in f)]
    compose = np.array([[table[i, j] for j in range(m)] for i in range(m)], np.uint8 if m <= 256 else np.uint16)
    goes_on = np.array([[_step(s, k)[1] for k in range(SYMBOLS)] + [False] * SYMBOLS for s in range(STATES)])
    return np.array(generators, compose.dtype), compose, np.array(elements, np.uint8), goes_on


def _scan(x: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of monoid elements (element 0 is neutral)."""
    m, n = len(compose), len(x)
    flat = compose.ravel()
    if n <= COLUMN:
        out = x.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-n // COLUMN)
    a = np.zeros(rows * COLUMN, x.dtype)
    a[:n] = x
    a = np.ascontiguousarray(a.reshape(rows, COLUMN).T)
    for c in range(1, COLUMN):
        a[c] = flat.take(a[c - 1].astype(np.int32) * m + a[c])
    before = np.zeros(rows, x.dtype)
    before[1:] = _scan(a[-1], compose)[:-1]
    return flat.take(before.astype(np.int32)[None, :] * m + a).T.ravel()[:n]


def starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where tokens start.  codes: code points of texts, one after another; firsts: where a text starts."""
    n = len(codes)
    generators, compose, elements, goes_on = _monoid()
    kind = classes().take(codes)
    white = kind == K_WHITE
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    last[-1] = True
    next_white = np.empty(n, bool)
    next_white[:-1] = white[1:]
    next_white |= last
    next_white[-1] = True
    symbol = kind.copy()  # L, N, O have the numbers of their classes
    w = np.flatnonzero(white)
    symbol[w] = np.where(codes[w] == 0x20, SPACE_IN, WHITE_IN) + ~next_white[w]
    q = np.flatnonzero(codes == 0x27)
    if len(q):
        q = q[~last[q]]
        b = codes[q + 1]
        symbol[q[(b == 0x73) | (b == 0x74) | (b == 0x6D) | (b == 0x64)]] = S1
        q = q[~last[q + 1]]
        b, c = codes[q + 1], codes[q + 2]
        symbol[q[(((b == 0x72) | (b == 0x76)) & (c == 0x65)) | ((b == 0x6C) & (c == 0x6C))]] = S2
    symbol[firsts] += SYMBOLS
    state = elements[:, START].take(_scan(generators.take(symbol), compose))
    previous = np.empty(n, np.uint8)
    previous[0] = START
    previous[1:] = state[:-1]
    return ~goes_on.ravel().take(previous.astype(np.int32) * (2 * SYMBOLS) + symbol)


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts' bytes, the pieces' edges in them (with the end), and which edge each text starts at (with the end)."""
    joined = "".join(texts)
    if not joined:
        return b"", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    raw = joined.encode()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if len(raw) == len(joined):
        codes = np.frombuffer(raw, np.uint8).astype(np.int32)
    else:
        codes = np.frombuffer(joined.encode("utf-32-le"), np.int32)
    first = (ends - sizes)[sizes > 0]
    at = np.flatnonzero(starts(codes, first))
    bounds = np.searchsorted(at, ends)
    if len(raw) != len(joined):
        width = 1 + (codes >= 0x80).astype(np.uint8) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.cumsum(width, dtype=np.int64)
        place -= width
        at = place[at]
    return raw, np.append(at, len(raw)), np.concatenate([[0], bounds])


def split(texts: list[str]) -> tuple[list[bytes], list[int]]:
    """The pieces of all texts as bytes, and where in that list each text's pieces start (with the end)."""
    raw, edges, bounds = boundaries(texts)
    i = edges.tolist()
    return [raw[a:b] for a, b in zip(i, i[1:], strict=False)], bounds.tolist()


def _cut(text: str, low: int, high: int) -> int:
    """The last place from low to high where a token starts whatever stands around, or 0.

    Such are a lone space between two other characters, and a change of class without
    white space that no apostrophe stands before.
    """
    codes = np.frombuffer(text[low - 1 : high + 1].encode("utf-32-le"), np.int32)
    kind = classes().take(codes)
    white = kind == K_WHITE
    change = (kind[1:] != kind[:-1]) & ~white[1:] & ~white[:-1] & (codes[:-1] != 0x27)
    lone = np.zeros(len(change), bool)
    lone[:-1] = (codes[1:-1] == 0x20) & ~white[:-2] & ~white[2:]
    at = np.flatnonzero(change | lone)
    return low + int(at[-1]) if len(at) else 0


def segments(text: str, limit: int) -> list[str]:
    """text cut into stretches of about `limit` where a token starts whatever stands around."""
    out, at = [], 0
    while len(text) - at > limit:
        low, cut = at + limit // 2 + 1, 0
        while not cut and low < len(text):  # a token longer than the limit is left whole
            high = min(len(text) - 1, low + max(2, limit // 2 - 1))
            cut, low = _cut(text, low, high), high
            if high == len(text) - 1:
                break
        if not cut:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out
