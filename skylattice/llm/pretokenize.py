"""Splitting text into the pieces of a byte-level BPE, as a composed finite-state transducer.

The pattern of the byte-level vocabularies is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
It is compiled by hand into 12 states over 12 character classes. A transition may say "a piece starts at this
character" and "a piece starts at the character before it" (the look-ahead after white space and the contractions
resolve one character late).

Texts are cut into chunks of equal length. Every chunk yields its state map (start state -> end state); a parallel
prefix scan composes the maps and so gives each chunk its true start state; then all chunks emit piece starts at once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

# Character classes.
OTHER_LETTER, STMD, LETTER_R, LETTER_V, LETTER_E, LETTER_L, NUMBER, SPACE, BLANK, APOSTROPHE, MARK, END = range(12)
# States.
START, IN_LETTERS, IN_NUMBER, IN_MARKS, SPACE_1, BLANK_1, SPACE_N, BLANK_N, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
HERE, BEFORE = 1, 2
N = 12
CHUNK = 256

#: White_Space of Unicode, fixed values.
WHITE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and out[class, state]."""
    nxt, out = np.zeros((N, N), np.uint8), np.zeros((N, N), np.uint8)
    letters = (OTHER_LETTER, STMD, LETTER_R, LETTER_V, LETTER_E, LETTER_L)
    begin = {c: IN_LETTERS for c in letters} | {NUMBER: IN_NUMBER, SPACE: SPACE_1, BLANK: BLANK_1, APOSTROPHE: QUOTE, MARK: IN_MARKS}
    attached = begin | {APOSTROPHE: IN_MARKS}  # after one space a piece has begun already
    quote_ends = {QUOTE_R: LETTER_E, QUOTE_V: LETTER_E, QUOTE_L: LETTER_L}
    for c in range(N):
        solid = c not in (SPACE, BLANK, END)
        for s in range(N):
            if s in quote_ends and c == quote_ends[s]:
                to, say = START, 0
            elif s in quote_ends:  # no contraction: the letter after the quote began a piece of letters
                to, say = (IN_LETTERS, BEFORE) if c in letters else (START, BEFORE) if c == END else (begin[c], HERE | BEFORE)
            elif c == END:
                to, say = START, 0
            elif s in (SPACE_1, SPACE_N, BLANK_1, BLANK_N) and not solid:
                to, say = (SPACE_N if c == SPACE else BLANK_N), 0
            elif s == SPACE_1:
                to, say = attached[c], 0
            elif s == SPACE_N:
                to, say = attached[c], BEFORE
            elif s == BLANK_N:
                to, say = begin[c], HERE | BEFORE
            elif s == QUOTE and c == STMD:
                to, say = START, 0
            elif s == QUOTE and c in (LETTER_R, LETTER_V, LETTER_L):
                to, say = {LETTER_R: QUOTE_R, LETTER_V: QUOTE_V, LETTER_L: QUOTE_L}[c], 0
            elif s in (QUOTE, IN_MARKS) and c in (APOSTROPHE, MARK):
                to, say = IN_MARKS, 0
            elif (s == IN_LETTERS and c in letters) or (s == IN_NUMBER and c == NUMBER):
                to, say = s, 0
            else:
                to, say = begin[c], HERE
            nxt[c, s], out[c, s] = to, say
    return nxt, out


NEXT, OUT = _tables()
#: State maps of two characters at once: NEXT2[(first * N + second), state].
NEXT2 = np.stack([NEXT[b][NEXT[a]] for a in range(N) for b in range(N)])
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point, from the general categories."""
    global _classes
    if _classes is None:
        kind = np.full(sys.maxunicode + 1, MARK, np.uint8)
        for i in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(i))[0]
            if k == "L":
                kind[i] = OTHER_LETTER
            elif k == "N":
                kind[i] = NUMBER
        kind[list(WHITE)] = BLANK
        kind[[ord(c) for c in "stmd"]] = STMD
        for c, v in (("r", LETTER_R), ("v", LETTER_V), ("e", LETTER_E), ("l", LETTER_L), (" ", SPACE), ("'", APOSTROPHE)):
            kind[ord(c)] = v
        _classes = kind
    return _classes


def piece_starts(cls: np.ndarray) -> np.ndarray:
    """Where pieces start in a sequence of classes (texts are closed by END), as a boolean per position."""
    n = len(cls)
    if not n:
        return np.zeros(0, bool)
    m = min(CHUNK, max(2, 1 << max(1, int(np.sqrt(n)).bit_length() - 2)))
    k = -(-n // m)
    padded = np.full(k * m, END, np.uint8)
    padded[:n] = cls
    rows = np.ascontiguousarray(padded.reshape(k, m).T)
    pairs = (rows[0::2].astype(np.int32) * N + rows[1::2]) * N
    flat2, flat, out = NEXT2.ravel(), NEXT.ravel(), OUT.ravel()
    maps = np.broadcast_to(np.arange(N, dtype=np.int32), (k, N)).copy()
    for p in pairs:  # the state map of every chunk
        maps = flat2.take(maps + p[:, None]).astype(np.int32)
    d = 1
    while d < k:  # inclusive prefix scan of the composition
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d], axis=1)
        d *= 2
    state = np.empty(k, np.int32)
    state[0] = START
    state[1:] = maps[:-1, START]
    said = np.empty((m, k), np.uint8)
    for j in range(m):
        at = rows[j].astype(np.int32) * N + state
        said[j] = out.take(at)
        state = flat.take(at).astype(np.int32)
    said = said.T.ravel()[:n]
    starts = (said & HERE).astype(bool)
    starts[:-1] |= (said[1:] & BEFORE).astype(bool)
    return starts


def pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (one extra byte after each), and start, end and text number of every piece."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    cls = classes().take(points)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends_at = np.cumsum(lengths + 1) - 1
    cls[ends_at] = END
    starts = piece_starts(cls)
    edges = starts.copy()
    edges[ends_at] = True
    edge = np.flatnonzero(edges)
    begins = starts[edge]
    widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.cumsum(widths) - widths
    byte = offset[edge]
    from_, to = byte[:-1][begins[:-1]], byte[1:][begins[:-1]]
    return joined.encode("utf-8"), from_, to, np.searchsorted(ends_at, edge[:-1][begins[:-1]])


def pieces_of_long(text: str, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The pieces of one text of any length, slice by slice.

    A piece start is a fresh start of the pattern, so a slice may begin at any of them. The last two pieces of a slice
    can still change with what follows and are carried over.
    """
    at, step = 0, size
    while at < len(text):
        part = text[at : at + step]
        last = at + step >= len(text)
        data, a, b, _ = pieces([part])
        found = [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        if last:
            yield found
            return
        if len(found) <= 3:  # a piece longer than the slice
            step *= 2
            continue
        yield found[:-2]
        at += len(part) - len((found[-2] + found[-1]).decode("utf-8"))
        step = size
