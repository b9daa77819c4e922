"""Fuzzy passages that repeat across documents, by chains of shared k-mers.

Seeds are all five-word shingles. Each is matched with its first occurrence in the corpus (least doc_id, then place)
and with the occurrence before it. A run of ``least`` words whose shingles first occur in different places is matched
with its own first occurrence too, which holds it whole, so that an exact copy is found although its parts occur
earlier elsewhere; any other run lies whole where its shingles first occur. Seeds travel packed by hash, so a passage
in a third of all documents costs each of them a bounded number of matches per seed and never a pair of each with
each. The matches of a document with one earlier document are chained: in order of their places, a Fenwick tree over
the places in the source gives the best predecessor under a cost for gaps. Chains are then aligned word by word and
cut at gaps into the longest parts of which ``percent`` agree, so two passages around different text are judged apart.
Parts are extended while words agree, and kept if they cover at least ``least`` words. A document's longest chains are
aligned first, as many as reach beyond each other; then all others but those that lie within a passage found by then.

The later occurrence is reported, the first one stays. Texts of fewer words than ``least`` and null texts have no
passages. Rows without an id are left out, and of rows that share an id the greatest text is used. Words are
lower-cased A-Z runs of bytes other than space and 0x09-0x0D. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.common import Prefix, Stages, as_bytes, buffers, from_bytes, id_filter, lower, mix, one_row_per_id, packed, powers, shingles, spans, unpacked, with_marks, words

K = 5
LEAST, PERCENT = 50, 75
#: Gain of a seed, cost of a skipped word on one side, and words that an extension may run below its best.
GAIN, GAP, DROP = 5.0, 0.1, 8
#: Words of a passage outside its outer seeds; places between seeds of an equal stretch; bytes of text whose shingles make a part.
SLACK, STEP, PART = 43, 7, 4 << 20
#: Shingles that are sent at once.
SENT = 600_000
#: Documents that are held against one source in one task.
SHARE = 500
SPANS = "doc_id long, source_id long, start long, end long, source_start long, source_end long, n_words long, n_same long"


def seeds(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and word number within the row of each shingle."""
    h, row, _ = shingles(data, offsets, K)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    keep = (count >= least - K + 1)[row]
    place = (np.arange(len(h)) - first[row])[keep]
    return h[keep], row[keep], place


def _dealt(h: np.ndarray, doc: np.ndarray, at: np.ndarray, parts: int) -> pa.RecordBatch:
    """Places packed by hash; a part holds all places of the low 40 bits of a hash."""
    return packed((h >> np.uint64(40)) % np.uint64(parts), [doc, at.astype(np.int32)], [as_bytes(h, 5)])


def _seed_rows(least: int, parts: int):
    """Shingles, dealt by hash."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            held, size = [], 0
            for lo, hi in spans(offsets):  # small ones are hashed at once, many are sent at once
                h, row, place = seeds(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], least)
                held.append((h, ids[lo:hi][row], place.astype(np.int32)))
                size += len(h)
                if size > SENT or hi == len(ids):
                    yield _dealt(*(np.concatenate(c) for c in zip(*held, strict=True)), parts)
                    held, size = [], 0

    return each


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, documents and places of each part; the rows come sorted by part."""
    for _, (doc, at), (raw,) in unpacked(batches, [np.int64, np.int32], [5]):
        yield from_bytes(raw), doc, at


def _repeats(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Those that occur twice or more, in order of their places: hash, document, place, and the index of the first one."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    often = np.zeros(len(h), bool)
    often[1:] = same
    often[:-1] |= same
    order = order[often]
    order = order[np.lexsort((at[order], doc[order], h[order]))]
    h, doc, at = h[order], doc[order], at[order]
    head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    return h, doc, at, np.flatnonzero(head)[np.cumsum(head) - 1]


def _to_documents(doc: np.ndarray, source: np.ndarray, at: np.ndarray, source_at: np.ndarray, parts: int) -> pa.RecordBatch:
    """Links packed by document; a place in the source is sent as its distance from that in the document, which is mostly 0 or the same again."""
    by = np.lexsort((at, doc))
    doc, source_at = doc[by], source_at - np.where(at < 0, ~at, at)
    return packed(mix(doc.view(np.uint64)) % np.uint64(parts), [doc, source[by], at[by], source_at[by]], [])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Document, source, place and place in the source of the links of each part."""
    for _, (doc, source, at, lean), _ in unpacked(batches, [np.int64, np.int64, np.int32, np.int32], []):
        yield doc, source, at, lean + np.where(at < 0, ~at, at)


def _matched(parts: int):
    """Links each occurrence of a repeated shingle with the first one, the first one with itself, and others also with the one before."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _hashes(batches):
            _, doc, at, first = _repeats(*found)
            own = np.arange(len(doc))
            second = np.flatnonzero(first < own - 1)
            second = second[doc[first[second]] != doc[second - 1]]
            own, other = np.concatenate([own, second]), np.concatenate([first, second - 1])
            mark = np.where(np.arange(len(own)) < len(doc), at[own], ~at[own])  # links with the one before are marked by the sign
            yield _to_documents(doc[own], doc[other], mark, at[other], parts)

    return each


def _runs_matched(parts: int):
    """Links each run with the first one in another document."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _hashes(batches):
            _, doc, at, first = _repeats(*found)
            own = np.flatnonzero(doc != doc[first])  # a run that comes first in its own document is in no earlier one
            yield _to_documents(doc[own], doc[first[own]], at[own], at[first[own]], parts)

    return each


def chains(at: np.ndarray, source: np.ndarray) -> list[list[int]]:
    """Chains of matches (places in the document and in the source), best first; a match lies in one chain at most."""
    order = np.lexsort((-source, at))
    x, y = at[order].tolist(), source[order].tolist()
    rank = (np.searchsorted(np.unique(source), source[order]) + 1).tolist()
    size = max(rank)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, back = [], []
    for i, r in enumerate(rank):
        total, best, k = x[i] + y[i], (-1e18, -1), r - 1
        while k:
            if tree[k] > best:
                best = tree[k]
            k &= k - 1
        gain = best[0] - GAP * total
        score.append(GAIN + max(gain, 0.0))
        back.append(best[1] if gain > 0 else -1)
        entry = (score[i] + GAP * total, i)
        while r <= size:
            if entry > tree[r]:
                tree[r] = entry
            r += r & -r
    out, used = [], [False] * len(x)
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(int(order[i]))
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def seams(doc: np.ndarray, source: np.ndarray, at: np.ndarray, source_at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place of each run of ``least`` words whose shingles all repeat, but not all in one stretch of first occurrences.

    Takes the links with first occurrences. As these are the same wherever a shingle stands, so is what this gives for
    a run, and the places of the first occurrences stand for its words.
    """
    n = least - K + 1
    order = np.lexsort((at, doc))
    doc, source, at, source_at = (c[order] for c in (doc, source, at, source_at))
    if len(at) < n:
        return np.zeros(0, np.uint64), doc[:0], at[:0]
    lean = source_at - at
    bend = np.concatenate([[0], np.cumsum((source[1:] != source[:-1]) | (lean[1:] != lean[:-1]))])
    begin = np.arange(len(at) - n + 1)
    end = begin + n - 1
    begin = begin[(doc[end] == doc[begin]) & (at[end] - at[begin] == n - 1) & (bend[end] > bend[begin])]
    up, down = powers(len(at))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(source.view(np.uint64)) + source_at.astype(np.uint64)) * up[: len(at)], dtype=np.uint64)])
    return mix((sums[begin + n] - sums[begin]) * down[begin]), doc[begin], at[begin]


def _thinned(doc: np.ndarray, source: np.ndarray, at: np.ndarray, source_at: np.ndarray) -> list[np.ndarray]:
    """Matches sorted by pair, without repeats; of equal stretches only the ends and every ``STEP``-th place are left. Also the number of each one's stretch."""
    lean = source_at - at
    order = np.lexsort((at, lean, source, doc))
    doc, source, at, source_at, lean = (c[order] for c in (doc, source, at, source_at, lean))
    step = np.concatenate([[K + 1], np.where((doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (lean[1:] == lean[:-1]), at[1:] - at[:-1], K + 1)])
    follows = np.append(step[1:] <= K, False)
    keep = (step > 0) & ((step > K) | ~follows | (at % STEP < step))
    return [c[keep] for c in (doc, source, at, source_at, np.cumsum(step > K))]


SENT_KINDS = "part int, c0 binary, c1 binary, r0 binary"
CHAIN = "doc_id long, source_id long, lead boolean, rank int, first int, last int, x array<int>, y array<int>"


def _chain_rows(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [[]] * 8
    return [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 3, *[pa.list_(pa.int32())] * 2], strict=True)]


def _long(x: np.ndarray, y: np.ndarray, least: int) -> list[list[int]]:
    """Chains that may grow to ``least`` words."""
    return [c for c in chains(x, y) if x[c[-1]] - x[c[0]] + SLACK >= least]


def _leads(found: list[tuple[int, int]]) -> list[bool]:
    """Which of a document's chains (first and last word) are aligned first: the longest, and each one that reaches beyond those before it."""
    held: list[tuple[int, int]] = []
    out = [False] * len(found)
    for i in sorted(range(len(found)), key=lambda i: (found[i][0] - found[i][1], i)):
        lo, hi = found[i]
        if not any(p <= lo and hi <= q for p, q in held):
            out[i] = True
            held.append((lo, hi))
            held.sort()
            merged = held[:1]
            for p, q in held[1:]:
                if p <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(q, merged[-1][1]))
                else:
                    merged.append((p, q))
            held = merged
    return out


def _stretches(x: np.ndarray, number: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The equal stretches of ``least`` words or more of a chain: first and last word."""
    head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    first, last = x[head], x[np.append(head[1:], len(x)) - 1] + K
    keep = last - first >= least
    return list(zip(first[keep].tolist(), last[keep].tolist(), strict=True))


def _chained(least: int, parts: int):
    """A row per chain that may be long enough, and one per run that ``seams`` finds; the matches come dealt by document."""
    def out(doc: np.ndarray, source: np.ndarray, at: np.ndarray, source_at: np.ndarray, stretch: np.ndarray) -> list[pa.Array]:
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])])) if len(doc) else np.zeros(0, np.int64)
        if not len(head):
            return _chain_rows([])
        ends = np.append(head[1:], len(doc))
        wide = np.minimum.reduceat(at, head), np.maximum.reduceat(at, head), np.minimum.reduceat(source_at, head), np.maximum.reduceat(source_at, head)
        rows, own, now = [], [], None

        def led() -> None:
            """Notes which chains are aligned first, and drops those within an equal stretch of these, which is a passage already."""
            leads, exact = _leads([r[4:6] for r in own]), []
            for r, lead in zip(own, leads, strict=True):
                if lead and r[0] != r[1]:
                    exact += _stretches(r[6], r[8], least)
            rows.extend((*r[:2], lead, *r[3:8]) for r, lead in zip(own, leads, strict=True) if lead or not any(p <= r[4] and r[5] <= q for p, q in exact))
            own.clear()

        for k in np.flatnonzero((wide[1] - wide[0] + SLACK >= least) & (wide[3] - wide[2] + SLACK >= least)).tolist():
            if doc[head[k]] != now:
                led()
                now = doc[head[k]]
            x, y, z = (c[head[k] : ends[k]] for c in (at, source_at, stretch))
            own += [(now, source[head[k]], False, rank, int(x[c[0]]), int(x[c[-1]]) + K, x[c], y[c], z[c]) for rank, c in enumerate(_long(x, y, least))]
        led()
        return _chain_rows(rows)

    names = [c.split()[0] for c in f"{CHAIN}, {SENT_KINDS}".split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, source, at, source_at in _links(batches):
            first = at >= 0
            run, run_doc, run_at = seams(*(c[first] for c in (doc, source, at, source_at)), least)
            sent = _dealt(run, run_doc, run_at, parts)
            if sent.num_rows:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(sent.num_rows, c.type) for c in _chain_rows([])), *sent.columns], names=names)
            at = np.where(first, at, ~at)
            other = (doc != source) | (at != source_at)
            found = out(*_thinned(*(c[other] for c in (doc, source, at, source_at))))
            yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(found[0]), c.type) for c in sent.columns)], names=names)

    return each


def _cover(order: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
    """The fewest ranges that cover what all do; ``order`` has them by their first place, longer ones first."""
    lo, hi = first[order], last[order]
    keep = np.concatenate([[True], hi[1:] > np.maximum.accumulate(hi)[:-1]])  # not within another one
    order, lo, hi = order[keep], lo[keep], hi[keep]
    out, i, reach = [], 0, -1
    while i < len(order):
        i = max(i, int(np.searchsorted(lo, reach, "right")) - 1)
        out.append(int(order[i]))
        reach, i = hi[i], i + 1
    return out


def _run_chains(least: int):
    """A chain per equal stretch that runs make up, as few as cover all of them."""
    names = [c.split()[0] for c in CHAIN.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, source, at, source_at in _links(batches):
            order = np.lexsort((at, source_at - at, source, doc))
            doc, source, at, source_at = (c[order] for c in (doc, source, at, source_at))
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1) | (source_at[1:] != source_at[:-1] + 1)]) if len(doc) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            last = at[np.append(head[1:], len(at)) - 1] + least if len(head) else head
            doc, source, at, source_at = (c[head] for c in (doc, source, at, source_at))
            order = np.lexsort((-last, at, doc))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(doc[order]) != 0, [True]])) if len(doc) else np.zeros(0, np.int64)
            rows = []
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                for i in _cover(order[lo:hi], at, last):
                    x = np.append(np.arange(at[i], last[i] - K, STEP), last[i] - K).astype(np.int32)
                    rows.append((doc[i], source[i], False, len(rows), int(at[i]), int(last[i]), x, x + (source_at[i] - at[i])))
            yield pa.RecordBatch.from_arrays(_chain_rows(rows), names=names)

    return each


def _extend(a: np.ndarray, b: np.ndarray) -> int:
    """How many words to take on, from the front, of two ends: to where agreement less difference is greatest."""
    n = min(len(a), len(b))
    best, taken, total, lo, size = 0, 0, 0, 0, 32
    while lo < n:
        hi = min(lo + size, n)
        score = total + np.cumsum(np.where(a[lo:hi] == b[lo:hi], 1, -3))
        top = np.maximum.accumulate(np.maximum(score, best))
        stop = np.flatnonzero(score < top - DROP)
        score = score[: stop[0]] if len(stop) else score
        if len(score) and score.max() > best:
            at = int(score.argmax())
            best, taken = int(score[at]), lo + at + 1
        if len(stop):
            break
        total, lo, size = int(score[-1]), hi, 2 * size
    return taken


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short ranges."""
    if not len(a) or not len(b):
        return 0
    if len(a) == 1 or len(b) == 1:
        return int((a == b).any())
    if len(a) == len(b) and (a == b).all():
        return len(a)
    if len(b) < len(a):
        a, b = b, a
    if len(a) <= 8:  # plain lists are faster than arrays here
        p, q = a.tolist(), b.tolist()
        row = [0] * (len(q) + 1)
        for x in p:
            left = up = 0
            for j, y in enumerate(q, 1):
                up, old = row[j], up
                left = row[j] = old + 1 if x == y else max(left, up)
        return row[-1]
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        new = row.copy()
        new[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def _parts(start: np.ndarray, end: np.ndarray, least: int, gains: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """First and last block of each longest run of blocks that agrees well enough, in place order.

    ``gains`` holds for each side the agreement less the share it needs, summed up to before and to after each block.
    """
    out, todo = [], [(0, len(start))]
    for before, after in gains:  # cut where even the best runs on both sides of a gap cannot pay for it
        cuts, n = [0], len(start)
        left, right = [0] * n, [0] * n
        own, gap = (after - before).tolist(), (after[:-1] - before[1:]).tolist()
        for i in range(n):
            left[i] = own[i] + max(0, left[i - 1] - gap[i - 1] if i else 0)
        for i in range(n - 1, -1, -1):
            right[i] = own[i] + max(0, right[i + 1] - gap[i] if i < n - 1 else 0)
        cuts = [i + 1 for i in range(n - 1) if left[i] + right[i + 1] < gap[i]]
        todo = [(max(lo, p), min(hi, q)) for lo, hi in todo for p, q in zip([0, *cuts], [*cuts, n], strict=True) if max(lo, p) < min(hi, q)]

    def fine(i: int, j: int) -> bool:
        return all(after[j] >= before[i] for before, after in gains)

    while todo:
        lo, hi = todo.pop()
        if lo >= hi:
            continue
        if fine(lo, hi - 1):
            i, j = lo, hi - 1
        else:
            last = [lo + int(np.flatnonzero(np.logical_and.reduce([after[lo:hi] >= before[k] for before, after in gains]) & (np.arange(lo, hi) >= k))[-1]) for k in range(lo, hi)]
            i = lo + int(np.argmax(end[last] - start[lo:hi]))
            j = last[i - lo]
        # text as long as a passage between two passages belongs to neither
        wide = [g for g in range(i, j) if start[g + 1] - end[g] >= least and min(end[g] - start[i], end[j] - start[g + 1]) >= least and gains[0][1][g] > gains[0][0][g + 1] and fine(i, g) and fine(g + 1, j)]
        if wide:
            todo += [(lo, wide[0] + 1), (wide[0] + 1, hi)]
            continue
        out.append((i, j))
        todo += [(lo, i), (j + 1, hi)]
    return sorted(out)


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, least: int = LEAST, percent: int = PERCENT) -> list[tuple[int, int, int, int, int]]:
    """For a chain of seeds at x and y the longest parts that agree: word ranges of both sides and how many words agree."""
    n = int(x[-1] - x[0]) + K
    if y[-1] - y[0] == n - K and np.array_equal(a[x[0] : x[0] + n], b[y[0] : y[0] + n]):  # a single block
        return [_grown(a, b, int(x[0]), int(x[0]) + n, int(y[0]), int(y[0]) + n, n)] if n - K + SLACK >= least else []
    x1, y1 = int(x[0]) + K, int(y[0]) + K
    blocks, same = [[x1 - K, x1, y1 - K, y1, 0, K]], K  # of equal words: ranges, and words that agree up to both ends
    for p, q in zip(x[1:].tolist(), y[1:].tolist(), strict=True):
        step = max(0, x1 - p, y1 - q)  # seeds overlap
        if step >= K:
            continue
        p, q = p + step, q + step
        if p == x1 and q == y1:
            gap = 0
        else:
            gap = _common(a[x1:p], b[y1:q])
        same += gap
        if gap < max(p - x1, q - y1):
            blocks.append([p, 0, q, 0, same, 0])
        x1, y1, same = p + K - step, q + K - step, same + K - step
        blocks[-1][1], blocks[-1][3], blocks[-1][5] = x1, y1, same
    x0, xe, y0, ye, low, high = np.array(blocks).T
    gains = [(100 * low - percent * (s - s[0]), 100 * high - percent * (e - s[0])) for s, e in ((x0, xe), (y0, ye))]
    out = []
    for i, j in _parts(x0, xe, least, gains):
        p, x1, q, y1, same = int(x0[i]), int(xe[j]), int(y0[i]), int(ye[j]), int(high[j] - low[i])
        if x1 - p - K + SLACK < least:
            continue
        out.append(_grown(a, b, p, x1, q, y1, same))
    return out


def _grown(a: np.ndarray, b: np.ndarray, p: int, x1: int, q: int, y1: int, same: int) -> tuple[int, int, int, int, int]:
    """Two ranges of words, extended while words agree."""
    n = _extend(a[x1:], b[y1:])
    same += int((a[x1 : x1 + n] == b[y1 : y1 + n]).sum())
    x1, y1 = x1 + n, y1 + n
    n = _extend(a[:p][::-1], b[:q][::-1])
    same += int((a[p - n : p] == b[q - n : q]).sum())
    return p - n, x1, q - n, y1, same


def _words_of(text: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = lower(np.frombuffer(text, np.uint8))
    start, end, _ = words(data, np.array([0, len(data)]))
    return Prefix(data).of(start, end), start, end


ALIGNED = f"{SPANS}, text_hash long, first long, last long"


def _aligned(least: int, percent: int):
    """Rows come sorted by source: its text in a row of its own, then the documents that are held against it."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, other = None, ()
        for b in batches:
            rows = []
            texts, marks = b.column("text"), b.column("text_hash").to_pylist()
            xs, ys = b.column("x"), b.column("y")
            for i, (doc, now) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("source_id").to_pylist(), strict=True)):
                if doc is None:
                    source, other = now, _words_of(texts[i].as_buffer())
                    continue
                assert now == source, "a source's text comes before its documents"
                (h, start, end), (g, start2, end2) = _words_of(texts[i].as_buffer()), other
                taken = np.zeros(len(h), bool)
                ends = xs[i].values.offsets.to_numpy()
                x, y = xs[i].values.values.to_numpy(), ys[i].values.values.to_numpy()
                for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                    if taken[x[lo] : x[hi - 1] + K].all():
                        continue
                    for x0, x1, y0, y1, same in align(h, g, x[lo:hi], y[lo:hi], least, percent):
                        if doc == source and x0 < y1:  # a passage may not be its own source
                            cut = y1 - x0
                            x0, same = x0 + cut, same - cut
                        if x1 <= x0 or taken[x0:x1].all():
                            continue
                        if x1 - x0 >= least and 100 * same >= percent * max(x1 - x0, y1 - y0):
                            taken[x0:x1] = True
                            rows.append((doc, source, int(start[x0]), int(end[x1 - 1]), int(start2[y0]), int(end2[y1 - 1]), x1 - x0, same, marks[i], x0, x1))
            cols = list(zip(*rows, strict=True)) or [[]] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return each


def _held(chained: DataFrame, docs: DataFrame, least: int, percent: int, stages: Stages, name: str) -> DataFrame:
    """Aligns chains; a source goes to as many tasks as its documents need, each with its text once. Only texts that take part are shuffled."""
    best = F.sort_array(F.collect_list(F.struct("rank", "x", "y")))
    pair = chained.groupBy("doc_id", "source_id").agg(best.alias("c")).select("doc_id", "source_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    shares = chained.groupBy("source_id").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("n"))
    none, text = F.lit(None), docs.select("doc_id", "text")
    ids = chained.select("doc_id").union(chained.select("source_id"))
    text = with_marks(text, text["doc_id"], id_filter(ids, stages, f"{name}-ids")).where("__q_in").drop("__q_in")
    lists = "array<array<int>>"
    sources = shares.join(text, shares["source_id"] == text["doc_id"]).select("source_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("share"), none.cast("long").alias("doc_id"), *(none.cast(lists).alias(c) for c in "xy"), "text")
    own = pair.join(shares, "source_id").join(text, "doc_id").select("source_id", F.pmod(F.xxhash64("doc_id"), "n").cast("int").alias("share"), "doc_id", "x", "y", "text")
    dealt = sources.unionByName(own).repartition("source_id", "share").sortWithinPartitions("source_id", "share", F.col("doc_id").asc_nulls_first())
    return dealt.select("doc_id", "source_id", "x", "y", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_aligned(least, percent), ALIGNED)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """A row per passage: byte ranges in the document and in the earlier one, its words, and how many of them agree.

    ``text_hash`` is the xxhash64 of the document's text, for tables in which other rows have the same id.
    """
    stages = Stages(docs.sparkSession, "chain-dedup")
    docs = one_row_per_id(docs, id_col, text_col)
    parts = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART
    link_kinds = "part int, c0 binary, c1 binary, c2 binary, c3 binary"

    def gathered(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part")

    seed = gathered(docs.mapInArrow(_seed_rows(least, parts), SENT_KINDS))
    match = gathered(seed.mapInArrow(_matched(parts), link_kinds))
    both = stages.write(match.mapInArrow(_chained(least, parts), f"{CHAIN}, {SENT_KINDS}"), "chains")
    chain = both.where("part is null").drop("part", "c0", "c1", "r0")
    run = gathered(both.where("part is not null").select("part", "c0", "c1", "r0"))
    more = stages.write(gathered(run.mapInArrow(_runs_matched(parts), link_kinds)).mapInArrow(_run_chains(least), CHAIN), "run-chains")
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    found = stages.write(_held(chain.where("lead"), docs, least, percent, stages, "leads"), "leads")
    # what lies within a passage that is found could only name a further source of it
    within = found.select(F.col("doc_id").alias("d"), F.col("first").alias("x0"), F.col("last").alias("x1"))
    rest = stages.write(chain.where("not lead").unionByName(more).join(within, (F.col("doc_id") == F.col("d")) & (F.col("x0") <= F.col("first")) & (F.col("last") <= F.col("x1")), "left_anti"), "rest")
    return found.unionByName(stages.write(_held(rest, docs, least, percent, stages, "others"), "others")).select(*names[:9])


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the passages cut out of ``text``, and ``n_chars`` set anew.

    Only rows whose id may have a passage are joined with the places to cut; the others pass by. Passages are cut from the rows whose id and text they were found in; other rows of the same id stay as they are, as
    do rows without an id or a text.
    """
    names = docs.columns
    cuts = found.groupBy(F.col("doc_id").alias("__q_id"), F.col("text_hash").alias("__q_hash")).agg(F.collect_list(F.struct("start", "end")).alias("__q_cuts"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, cut in enumerate(b.column("__q_cuts").to_pylist()):
                if cut:
                    raw, at, keep = texts[i].encode(), 0, []
                    for c in sorted(cut, key=lambda c: (c["start"], c["end"])):
                        keep.append(raw[at : max(at, c["start"])])
                        at = max(at, c["end"])
                    texts[i] = b"".join([*keep, raw[at:]]).decode()
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    marked = with_marks(docs, docs["doc_id"], id_filter(found.select("doc_id"), Stages(docs.sparkSession, "cuts"), "ids"))
    touched = marked.where("__q_in").drop("__q_in")
    same = (touched["doc_id"].cast("long") == F.col("__q_id")) & (F.xxhash64(F.coalesce(touched["text"].cast("string"), F.lit(""))) == F.col("__q_hash"))
    cut = touched.join(cuts, same, "left").select(*(touched[c] for c in names), "__q_cuts").mapInArrow(each, docs.schema)
    out = cut.union(marked.where("not __q_in").select(*names))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else out


def op9_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
