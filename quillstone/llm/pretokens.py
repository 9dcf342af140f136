"""The word splitter of byte-level BPE as a deterministic transducer, run over chunks in parallel.

The pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|white(?!other)|white becomes a Mealy machine with twelve
states over eleven character classes. A transition's output says where tokens start: bit 0 at this
character, bit 1 at the one before (a decision that had to wait for one more character). The machine runs
over many chunks at once: first each chunk's state map (entry state -> exit state) for all entry states, then
a parallel prefix scan composes the maps, which gives each chunk its true entry state, then one more run emits.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, STMD, RV, E, ELL, END = range(11)
CLASSES = 11
(S_START, S_L, S_N, S_O, S_SP1, S_WH1, S_SPN, S_WHN, S_QUOTE, S_RV, S_ELL, S_DONE) = range(12)
STATES = 12
_WHITE = {*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
BREAK = ""  # between texts in a joined stream; its class comes from its place, not from its code


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(_WHITE)] = WHITE
    table[0x20] = SPACE
    for chars, k in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", ELL)):
        for x in chars:
            table[ord(x)] = k
    return table


def _from_word(state: int, c: int) -> tuple[int, int]:
    """Transition out of a run of letters, numbers or others; 1: a token starts here."""
    if c == END:
        return S_START, 1
    if c == SPACE:
        return S_SP1, 1
    if c == WHITE:
        return S_WH1, 1
    if c == QUOTE:
        return (S_O, 0) if state == S_O else (S_QUOTE, 1)
    to = S_N if c == NUMBER else S_O if c == OTHER else S_L
    return to, int(to != state)


def _fresh(c: int) -> int:
    """State after a character that starts a token."""
    return {END: S_START, SPACE: S_SP1, WHITE: S_WH1, QUOTE: S_QUOTE, NUMBER: S_N, OTHER: S_O}.get(c, S_L)


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output, each indexed by state * CLASSES + class."""
    to = np.zeros((STATES, CLASSES), dtype=np.uint8)
    out = np.zeros((STATES, CLASSES), dtype=np.uint8)
    for s in range(STATES):
        for c in range(CLASSES):
            if s in (S_START, S_DONE):
                n, o = _fresh(c), 1
            elif s in (S_L, S_N, S_O):
                n, o = _from_word(s, c)
            elif s in (S_SP1, S_WH1, S_SPN, S_WHN):
                many = 2 if s in (S_SPN, S_WHN) else 0
                if c == END:
                    n, o = S_START, 1
                elif c in (SPACE, WHITE):
                    n, o = (S_SPN if c == SPACE else S_WHN), 0
                elif s in (S_SP1, S_SPN):  # the blank joins what follows
                    n, o = (S_O if c == QUOTE else _fresh(c)), many
                else:
                    n, o = _fresh(c), many | 1
            elif s == S_QUOTE:
                if c == STMD:
                    n, o = S_DONE, 0
                elif c == RV:
                    n, o = S_RV, 0
                elif c == ELL:
                    n, o = S_ELL, 0
                else:
                    n, o = _from_word(S_O, c)
            elif (s == S_RV and c == E) or (s == S_ELL and c == ELL):
                n, o = S_DONE, 0
            else:  # the letter after the quote began a word of its own
                n, o = _from_word(S_L, c)
                o |= 2
            to[s, c], out[s, c] = n, o
    return to.ravel(), out.ravel()


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, in log2(n) parallel steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def starts(kinds: np.ndarray, size: int = 256) -> np.ndarray:
    """Whether a token starts at each character of a stream of classes. The stream ends with class END."""
    n = len(kinds)
    if not n:
        return np.zeros(0, dtype=bool)
    to, out = machine()
    rows = -(-n // size)
    grid = np.full(rows * size, END, dtype=np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, size).T)  # a step reads one contiguous row
    state = np.tile(np.arange(STATES, dtype=np.uint8)[:, None], (1, rows))
    for k in range(size):
        state = to[state * np.uint8(CLASSES) + grid[k]]
        if k % 4 == 3 and len(state) > 1 and (state == state[0]).all():
            state = state[:1]  # every entry state has led to the same one: the maps are constant from here
    state = np.broadcast_to(state, (STATES, rows)) if len(state) == 1 else state
    entry = np.full(rows, S_START, dtype=np.uint8)
    entry[1:] = scan(np.ascontiguousarray(state.T))[:-1, S_START]
    marks = np.empty((size, rows), dtype=np.uint8)
    for k in range(size):
        at = entry * np.uint8(CLASSES) + grid[k]
        marks[k] = out[at]
        entry = to[at]
    marks = marks.T.ravel()[:n]
    begins = (marks & 1).astype(bool)
    begins[:-1] |= (marks[1:] & 2).astype(bool)
    return begins


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in one stream, where in it each word starts and ends, and the number of words of each text."""
    joined = BREAK.join(texts) + BREAK
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = classes()[codes]
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    kinds[ends] = END
    at = np.flatnonzero(starts(kinds))
    to = np.append(at[1:], len(codes))
    keep = kinds[at] != END
    at, to = at[keep], to[keep]
    counts = np.diff(np.searchsorted(at, ends), prepend=0)
    wide = np.ones(len(codes) + 1, dtype=np.uint8)
    for least in (0x80, 0x800, 0x10000):
        wide[1:] += codes >= least  # bytes of the character before
    wide[0] = 0
    place = np.cumsum(wide, dtype=np.int32)
    return np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8), place[at].astype(np.int64), place[to].astype(np.int64), counts


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All words of the texts in order, and the number of words of each text."""
    stream, at, to, counts = spans(texts)
    data = stream.tobytes()
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at.tolist(), to.tolist())], counts
