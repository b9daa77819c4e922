"""Pre-tokens of texts found with array operations, and their ids, each asked for once per worker.

Texts are handled as code points in chunks; a table gives each one's class (letter, number, white space, other), and
the rules of the pre-token pattern become rules about runs of a class. Pre-tokens are known by a 64-bit hash.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from loomtrail.llm.common import BASE, MIX2, buffers, mix, powers, ragged, spans

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points of Unicode's White_Space (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes of text that are handled at once.
CHUNK = 512 << 10
#: The first combining mark: texts without code points from here on are in composed form.
MARKS = 0x300

_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _TABLE:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[WHITE] = SPACE
        _TABLE.append(table)
    return _TABLE[0]


class Chunk:
    """Some texts as one array of code points; ``first`` holds where each begins, and the end."""

    def __init__(self, texts: list[str]) -> None:
        self.text = "".join(texts)
        self.points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and class of each run of one class within a text, and whether a run of the same text follows."""
        kind = classes()[self.points]
        new = np.ones(len(kind) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:-1])
        cut = np.zeros(len(kind) + 1, bool)
        cut[self.first] = True
        at = np.flatnonzero(new | cut)
        return at, kind[at[:-1]], ~cut[at[1:]]

    def spans(self, is_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(is_start)
        return at[:-1], at[1:]


def gpt_pieces(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the pattern of the byte-level vocabularies."""
    points = chunk.points
    at, kind, more = chunk.runs()
    start = np.zeros(len(points) + 1, bool)
    start[at] = True
    start[chunk.first] = True
    begin, end = at[:-1], at[1:]
    white = (kind == SPACE) & more
    start[end[white & (end - begin > 1)] - 1] = True  # the last white character stands alone or joins what follows
    joins = white & (points[end - 1] == 32) if len(points) else white
    start[end[joins]] = False
    quote = np.flatnonzero((kind[:-1] == OTHER) & (end[:-1] - begin[:-1] == 1) & more[:-1] & (kind[1:] == LETTER) & start[begin[:-1]]) if len(kind) else np.zeros(0, np.int64)
    quote = quote[points[begin[quote]] == ord("'")]
    if len(quote):
        lo, hi = end[quote], end[quote + 1]
        a = points[lo]
        b = np.where(hi - lo > 1, points[np.minimum(lo + 1, len(points) - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        lo, hi, size = lo[size > 0], hi[size > 0], size[size > 0]
        start[lo] = False
        start[(lo + size)[lo + size < hi]] = True
    return chunk.spans(start)


def word_pieces(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without white space, cut between letters and other characters where no mark or quote is near."""
    at, kind, more = chunk.runs()
    start = np.zeros(len(chunk.points) + 1, bool)
    start[at] = True
    start[chunk.first] = True
    if (chunk.points >= MARKS).any():  # composition may join classes: cut at white space only
        inner = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] != SPACE) & more[:-1]) + 1
        start[at[inner]] = False
    else:
        quote = np.flatnonzero(chunk.points == ord("'"))
        quote = quote[quote + 1 < len(chunk.points)]
        plain = ~np.isin(quote + 1, chunk.first) & (classes()[chunk.points[quote + 1]] == LETTER)
        start[quote[plain] + 1] = False
    lo, hi = chunk.spans(start)
    solid = classes()[chunk.points[lo]] != SPACE if len(lo) else np.zeros(0, bool)
    return lo[solid], hi[solid]


class Ids:
    """Ids by pre-token; all are forgotten once there are more than ``most``.

    Texts that hold one of ``marks``, the contents of special tokens, go to ``whole`` as they are; without marks none do.
    """

    SLOTS = 22

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], marks: list[str] | None = None, whole: Callable[[list[str]], list[list[int]]] | None = None, most: int = 1_500_000) -> None:
        self.encode, self.cut, self.marks, self.whole, self.most = encode, cut, marks or [], whole, most
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(1 << self.SLOTS, -1, np.int32)
        self.rest: dict[int, int] = {}
        self.n, self.n_ids = 0, 0
        self.hash, self.start, self.size = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.int32)

    def add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, size = self.encode(pieces)
        n, m = self.n + len(pieces), self.n_ids + len(ids)
        for name, least in (("hash", n), ("start", n), ("size", n), ("ids", m)):
            old = getattr(self, name)
            if len(old) < least:
                grown = np.zeros(max(least, 2 * len(old)), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.hash[self.n : n], self.size[self.n : n], self.ids[self.n_ids : m] = hashes, size, ids
        self.start[self.n : n] = self.n_ids + np.cumsum(size) - size
        slots, at = (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64), np.arange(self.n, n, dtype=np.int32)
        free = self.slot[slots] < 0
        self.slot[slots[free]] = at[free]
        lost = self.slot[slots] != at
        self.rest.update(zip(hashes[lost].tolist(), at[lost].tolist(), strict=True))
        self.n, self.n_ids = n, m

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each text."""
        marked = [i for i, t in enumerate(texts) if any(m in t for m in self.marks)]
        if not marked:
            return self.plain(texts)
        ids, size = self.plain(["" if i in set(marked) else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(size)[:-1])
        for i, own in zip(marked, self.whole([texts[i] for i in marked]), strict=True):
            parts[i] = np.array(own, np.int32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.most:
            self.clear()
        chunk = Chunk(texts)
        lo, hi = self.cut(chunk)
        if not len(lo):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        n = len(chunk.points)
        up, down = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((chunk.points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(MIX2) + np.uint64(BASE))
        at = self.slot[(hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)].astype(np.int64)
        missed = np.flatnonzero((at < 0) | (self.hash[at] != hashes))
        if len(missed):
            unique, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            found = np.fromiter((self.rest.get(h, -1) for h in unique.tolist()), np.int64, len(unique))
            new = np.flatnonzero(found < 0)
            if len(new):
                where = missed[first[new]]
                found[new] = np.arange(self.n, self.n + len(new))
                self.add(unique[new], [chunk.text[a:b] for a, b in zip(lo[where].tolist(), hi[where].tolist(), strict=True)])
            at[missed] = found[back]
        size = self.size[at]
        before = np.concatenate([[0], np.cumsum(size)])
        ends = before[np.searchsorted(lo, chunk.first[1:])]
        return self.ids[ragged(self.start[at], size)], np.diff(ends, prepend=0)


def joined(encode: Callable[[list[str]], list[list[int]]], mark: str, mark_id: int, alone: Callable[[str], bool]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes many pre-tokens as a few texts, with ``mark`` behind each one; ``alone`` are those that would disturb this."""
    def each(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        single = [i for i, x in enumerate(pieces) if alone(x)]
        apart = set(single)
        plain = [i for i in range(len(pieces)) if i not in apart]
        texts = [mark.join([pieces[i] for i in plain[k : k + 500]]) + mark for k in range(0, len(plain), 500)]
        parts = [np.array([i for x in encode(texts[k : k + 16]) for i in x], np.int32) for k in range(0, len(texts), 16)]
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        ends = np.flatnonzero(ids == mark_id)
        assert len(ends) == len(plain), "each mark must give one id"
        size = np.diff(ends, prepend=-1) - 1
        ids = np.delete(ids, ends)
        if not single:
            return ids, size
        both = encode([pieces[i] for i in single])
        order = np.argsort(np.concatenate([plain, single]), kind="stable")
        sizes = np.concatenate([size, np.fromiter(map(len, both), np.int64, len(both))]).astype(np.int64)
        flat = np.concatenate([ids, np.array([i for x in both for i in x], np.int32)])
        starts = np.cumsum(sizes) - sizes
        return flat[ragged(starts[order], sizes[order])], sizes[order]

    return each


def chunks(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about ``CHUNK`` bytes and their texts; null is empty."""
    for lo, hi in spans(buffers(column)[1], CHUNK):
        yield lo, hi, [x or "" for x in column[lo:hi].to_pylist()]
