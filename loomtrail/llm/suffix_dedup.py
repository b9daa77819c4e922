"""Removal of repeated 100-byte strings, by suffix arrays of the places where they can repeat.

Of the hashes of all ``K``-byte strings in a 100-byte string the least one is its anchor, so equal strings have equal
anchors at equal places. Each text is cut into stretches, one per anchor: the strings that share it, with all their
bytes. Only stretches whose anchor occurs again, in them or elsewhere, can hold repeats. Equal stretches are first
reduced to the earliest one, so that a group of copies costs a few bytes each; the others of them are removed whole. The
different stretches of an anchor form a text, whose suffix array brings equal strings together: where neighbours have
100 bytes in common, all but the first are removed too. Before that, stretches are narrowed to the parts whose bytes
beside the anchor occur again, so an anchor that a third of all documents hold is split by what stands around it. Anchors travel packed by hash, and bytes only of stretches that
differ from others of their anchor. Texts are read in pieces, so very long ones take no more memory than short ones.

The suffix array is built by grouping: suffixes are grouped by first byte, and groups are taken in descending order;
each member points to the nearest earlier suffix of a lower group, which is thereby known to continue with the group's
Lyndon word and moves behind the others of its group, further the more members point to it. When all groups are taken
they are sorted by Lyndon prefix, and one pass over the array places every suffix next to its successor's place,
without renaming and recursion. Many short texts are built at once, one group of each per step.

Strings never cross documents. Null and empty texts have no bytes. Rows without an id are left out, and of rows that
share an id the greatest text is used. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.common import SPAN, Prefix, Stages, as_bytes, buffers, from_bytes, mix, one_row_per_id, packed, ragged, spans, unpacked

LENGTH, K = 100, 24
WINDOW = LENGTH - K + 1
#: Bytes of texts whose suffix arrays are built at once.
BATCH = 2 << 20
#: Bytes of which batches of one size are chosen, and bytes beside an anchor that tell its strings apart.
POOL, SIDE = 24 << 20, 38
#: Anchors that are sent at once, and bytes of text whose anchors make a part.
SENT, PART = 200_000, 8 << 20


def suffix_arrays(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffix arrays of many texts, one behind the other; text t is s[first[t]:first[t + 1]] and ends with a 0 found nowhere else in it."""
    n = len(s)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    sa = np.lexsort((np.arange(n), s, owner))
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = (s[sa[1:]] != s[sa[:-1]]) | (owner[sa[1:]] != owner[sa[:-1]])
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, n))
    group, count, start_at = np.empty(n, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    group[sa] = np.repeat(starts, sizes)
    count[starts] = sizes
    start_at[starts + sizes] = starts
    base = first[:-1].copy()
    prev = np.full(n, -1, np.int64)
    end, live = first[1:].copy(), np.arange(len(size))
    while len(live):
        g = start_at[end[live]]
        m = count[g]
        i = sa[ragged(g, m)]
        low, bottom = np.repeat(g, m), np.repeat(base[live], m)
        p = i - 1
        prev[i] = p
        todo = np.flatnonzero((p >= bottom) & (group[np.maximum(p, 0)] >= low))
        while len(todo):  # past members of this group and of those taken before, which know their own predecessors
            prev[i[todo]] = prev[prev[i[todo]]]
            p = prev[i[todo]]
            todo = todo[(p >= bottom[todo]) & (group[np.maximum(p, 0)] >= low[todo])]
        p = prev[i]
        p[p < bottom] = -1
        prev[i] = p
        p, hits = np.unique(p[p >= 0], return_counts=True)
        if len(p):
            order = np.lexsort((hits, group[p]))
            p, hits, old = p[order], hits[order], group[p[order]]
            new_old = np.concatenate([[True], old[1:] != old[:-1]])
            at_old = np.flatnonzero(new_old)
            moved = np.diff(np.append(at_old, len(p)))
            o = old[at_old]
            tail = o + count[o] - moved
            place = ragged(tail, moved)
            mark = np.zeros(n, bool) if n < 4096 else _flag(n)
            mark[p] = True
            stay = sa[place]
            stay = stay[~mark[stay]]
            gap = isa[p]
            gap = np.sort(gap[gap < np.repeat(tail, moved)])
            # both lie group by group in the same order, and each group has as many of one as of the other
            sa[gap], isa[stay] = stay, gap
            sa[place], isa[p] = p, place
            mark[p] = False
            sub = np.flatnonzero(new_old | np.concatenate([[True], hits[1:] != hits[:-1]]))
            sub_size = np.diff(np.append(sub, len(p)))
            sub_start = place[sub]
            count[o] -= moved
            left = count[o] > 0
            start_at[tail[left]] = o[left]
            count[sub_start] = sub_size
            start_at[sub_start + sub_size] = sub_start
            group[p] = np.repeat(sub_start, sub_size)
        end[live] = g
        live = live[g > base[live]]
    free, placed = np.arange(n + 1), np.zeros(n, bool)
    out = np.full(n, -1, np.int64)
    out[base] = first[1:] - 1  # the text's end is its least suffix
    placed[out[base]] = True
    free[group[out[base]]] += 1
    live, k = np.flatnonzero(size > 1), 0
    while len(live):
        j = out[base[live] + k] - 1
        bottom = base[live]
        on = np.flatnonzero(j >= bottom)
        j = j[on]
        while len(j):
            fresh = ~placed[j]
            on, j = on[fresh], j[fresh]
            slot = group[j]
            out[free[slot]] = j  # one suffix of each text at most, so no slot is taken twice
            free[slot] += 1
            placed[j] = True
            j = prev[j]
            up = j >= 0
            on, j = on[up], j[up]
        k += 1
        live = live[size[live] > k]
    return out


_MARK: list[np.ndarray] = [np.zeros(0, bool)]


def _flag(n: int) -> np.ndarray:
    """A cleared array that is kept between steps."""
    if len(_MARK[0]) < n:
        _MARK[0] = np.zeros(n, bool)
    return _MARK[0]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first and last string start (places in ``data``) of each stretch, and whether it holds its anchor twice."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    at = np.arange(len(data) - K + 1)
    h = Prefix(data).of(at, at + K)
    low, width = h, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + LENGTH <= offsets[1:][row])
    value, row = low[start], row[start]
    # a new stretch begins where the least hash, the row, or the run of places changes, or where the anchor was passed by
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    cut = np.flatnonzero(new)
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
    long = np.flatnonzero(last - first >= WINDOW)  # equal hashes one behind the other: such runs are cut at fixed lengths
    if len(long):
        parts = (last[long] - first[long]) // WINDOW + 1
        begin = np.repeat(first[long], parts) + WINDOW * ragged(np.zeros(len(long), np.int64), parts)
        stop = np.minimum(begin + WINDOW - 1, np.repeat(last[long], parts))
        keep = np.ones(len(first), bool)
        keep[long] = False
        order = np.argsort(np.concatenate([first[keep], begin]), kind="stable")
        value = np.concatenate([value[cut][keep], np.repeat(value[cut][long], parts)])[order]
        rows = np.concatenate([row[cut][keep], np.repeat(row[cut][long], parts)])[order]
        value, row, first, last = value, rows, np.concatenate([first[keep], begin])[order], np.concatenate([last[keep], stop])[order]
    else:
        value, row = value[cut], row[cut]
    width = last - first + WINDOW
    same = h[ragged(first, width)] == np.repeat(value, width)
    twice = np.add.reduceat(same.astype(np.int32), np.cumsum(width) - width) > 1 if len(width) else np.zeros(0, bool)
    return value, row, first, last, twice


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their bytes and offsets, and where the bytes begin in the row; long rows come in pieces that share ``LENGTH`` - 1 bytes."""
    for lo, hi in spans(offsets):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if end - begin <= 2 * SPAN:
            yield lo, hi, 0, data[begin:end], offsets[lo : hi + 1] - begin
            continue
        for at in range(0, end - begin, SPAN):
            own = data[begin + at : min(begin + at + SPAN + LENGTH - 1, end)]
            yield lo, hi, at, own, np.array([0, len(own)])


def _found(parts: int):
    """Anchors, dealt by hash, with a hash of the stretch and its size; the size's high bit marks an anchor that it holds twice."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            held, size = [], 0
            for lo, hi, at, own, cuts in _pieces(data, offsets):
                h, row, first, last, twice = anchors(own, cuts)
                seg = Prefix(own).of(first, last + LENGTH) if len(h) else h
                held.append((h, seg, ids[lo:hi][row], (first - cuts[row] + at).astype(np.int32), ((last - first) | (twice << 7)).astype(np.uint8)))
                size += len(h)
                if size > SENT:
                    yield _sent(held, parts)
                    held, size = [], 0
            if held:
                yield _sent(held, parts)

    return each


def _sent(held: list[tuple[np.ndarray, ...]], parts: int) -> pa.RecordBatch:
    h, seg, doc, at, size = (np.concatenate(c) for c in zip(*held, strict=True))
    part = (h >> np.uint64(40)) % np.uint64(parts)
    return packed(part, [doc, at], [as_bytes(h, 5), as_bytes(seg, 8), as_bytes(size, 1)])


def _again(parts: int):
    """Stretches that are copies of an earlier one, and those whose bytes are wanted: the first of each kind where an anchor has several."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (doc, at), (h, seg, size) in unpacked(batches, [np.int64, np.int32], [5, 8, 1]):
            h, seg, size = from_bytes(h), from_bytes(seg), size.reshape(-1)
            twice, size = size >= 128, (size & 127).astype(np.int32)
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            often = np.zeros(len(h), bool)
            often[1:] = same
            often[:-1] |= same
            order = order[often | twice[order]]
            order = order[np.lexsort((at[order], doc[order], seg[order], h[order]))]
            h, seg, doc, at, size, twice = (c[order] for c in (h, seg, doc, at, size, twice))
            group = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            kind = group | np.concatenate([[True], (seg[1:] != seg[:-1]) | (size[1:] != size[:-1])]) if len(h) else group
            number = np.cumsum(group) - 1
            several = (np.bincount(number, kind) > 1) | (np.bincount(number, twice) > 0) if len(h) else group
            wanted = kind & several[number]
            number = np.where(wanted, h | np.uint64(part + 1 << 40), np.uint64(0)).view(np.int64)  # a copy has no anchor here
            keep = ~kind | wanted
            doc, at, size, number = doc[keep], at[keep], size[keep], number[keep]
            yield packed(mix(doc.view(np.uint64)) % np.uint64(parts), [doc, at, at + size + np.int32(LENGTH), number], [])

    return each


MARKS = "doc_id long, starts array<int>, stops array<int>, at array<int>, until array<int>, anchor array<long>"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document: byte ranges that are copies, and stretches whose bytes are wanted with their anchors."""
    for _, (doc, start, stop, anchor), _ in unpacked(batches, [np.int64, np.int32, np.int32, np.int64], []):
        order = np.lexsort((start, doc))
        doc, start, stop, anchor = (c[order] for c in (doc, start, stop, anchor))
        ids, first = np.unique(doc, return_index=True)
        lists = []
        for keep in (anchor == 0, anchor != 0):
            ends = pa.array(np.concatenate([[0], np.cumsum(keep)])[np.append(first, len(doc))].astype(np.int32))
            lists.append([pa.ListArray.from_arrays(ends, pa.array(c[keep])) for c in (start, stop, anchor)])
        yield pa.RecordBatch.from_arrays([pa.array(ids), *lists[0][:2], *lists[1]], names=[c.split()[0] for c in MARKS.split(", ")])


STRETCH = "h long, doc_id long, at int, bytes binary"


def _narrowed(flat: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of stretches whose strings have more in common than the anchor: key, number of the stretch, and bytes from and to.

    A string belongs to the first occurrence of its anchor. If it starts ``SIDE`` bytes before that or less it holds as
    many bytes behind it, else it holds more than as many before it. So the strings of an occurrence fall into two
    parts, each known by the anchor and those bytes too, and two strings of one part are never equal.
    """
    n = size - K + 1
    at = ragged(start, n)
    sums = Prefix(flat)
    grams = sums.of(at, at + K)
    head = np.cumsum(n) - n
    place = np.flatnonzero(np.repeat(np.minimum.reduceat(grams, head), n) == grams) if len(n) else head
    stretch, anchor = np.searchsorted(head, place, "right") - 1, at[place]
    lo, hi = start[stretch], np.minimum((start + size - LENGTH)[stretch], anchor)
    more = np.flatnonzero(stretch[1:] == stretch[:-1]) + 1  # behind the occurrence before
    lo[more] = np.maximum(lo[more], anchor[more - 1] + 1)
    out = []
    for side, first, last, near, far in ((1, np.maximum(lo, anchor - SIDE), hi, anchor + K, anchor + K + SIDE), (2, lo, np.minimum(hi, anchor - SIDE - 1), anchor - SIDE - 1, anchor)):
        some = np.flatnonzero(first <= last)
        key = mix((h[stretch[some]] * np.uint64(3) + np.uint64(side)) ^ sums.of(near[some], far[some]))
        out.append((key, stretch[some], first[some], last[some] + LENGTH))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that are wanted of a document."""
    for b in batches:
        data, offsets = buffers(b.column("text"))
        lists, untils, names = b.column("at"), b.column("until"), b.column("anchor")
        for lo, hi in spans(offsets):
            wanted = lists[lo:hi]
            n = wanted.value_lengths().to_numpy()
            row = np.repeat(np.arange(lo, hi), n)
            at, until = wanted.flatten().to_numpy().astype(np.int64), untils[lo:hi].flatten().to_numpy()
            size = until - at
            flat = data[ragged(offsets[row] + at, size)]
            start = np.cumsum(size) - size
            key, stretch, begin, end = _narrowed(flat, start, size, names[lo:hi].flatten().to_numpy().view(np.uint64))
            raw = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)), pa.py_buffer(flat[ragged(begin, end - begin)])])
            place = (at[stretch] + begin - start[stretch]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(b.column("doc_id").to_numpy()[row[stretch]]), pa.array(place), raw], names=["h", "doc_id", "at", "bytes"])


def equal_neighbours(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Whether neighbours of a suffix array have a common prefix of ``LENGTH`` or more."""
    out = np.zeros(max(len(sa) - 1, 0), bool)
    if len(s) >= LENGTH:
        strings = np.lib.stride_tricks.sliding_window_view(s, LENGTH)
        for lo in range(0, len(out), 4096):
            hi = min(lo + 4096, len(out))
            own = strings[sa[lo : hi + 1]]
            out[lo:hi] = (own[1:] == own[:-1]).all(axis=1)
    return out


def repeats(groups: list[list[tuple[int, int, bytes]]]) -> list[tuple[int, int, int]]:
    """Byte ranges (doc_id, from, to) of repeated strings; a group is the stretches (doc_id, place, bytes) of one anchor."""
    parts, first, docs, places, ends = [], [0], [], [], []
    total = 0
    for group in groups:
        for doc, place, raw in group:
            parts.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 2)
            parts.append(np.ones(1, np.int64))
            docs.append(doc)
            places.append(place)
            total += len(raw) + 1
            ends.append(total - 1)
        parts.append(np.zeros(1, np.int64))
        total += 1
        first.append(total)
    s, first = np.concatenate(parts), np.array(first)
    sa = suffix_arrays(s, first)
    ends = np.array(ends)
    stretch = np.minimum(np.searchsorted(ends, sa, "right"), len(ends) - 1)
    whole = (sa + LENGTH <= ends[stretch]) & (s[sa] > 1)  # no mark between texts
    sa, stretch = sa[whole], stretch[whole]
    text = np.searchsorted(first, sa, "right")
    begin = np.concatenate([[0], ends[:-1] + 1])
    begin[np.isin(begin, first[1:] - 1)] += 1  # behind the end of the text before
    doc, place = np.array(docs)[stretch], np.array(places)[stretch] + sa - begin[stretch]
    new = np.ones(len(sa), bool)
    new[1:] = ~equal_neighbours((s & 0xFF).astype(np.uint8), sa) | (text[1:] != text[:-1])
    run = np.cumsum(new) - 1  # equal strings are neighbours in the array
    order = np.lexsort((place, doc, run))
    again = ~np.concatenate([[True], run[order][1:] != run[order][:-1]])
    doc, place = doc[order][again], place[order][again]
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    stop = np.append(cut, len(doc))[1:] - 1  # none where nothing is repeated
    return list(zip(doc[cut].tolist(), place[cut].tolist(), (place[stop] + LENGTH).tolist(), strict=True))


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of the anchors of a partition; rows come sorted by anchor, document and place.

    Equal parts are reduced to the first one. Anchors are taken by size, as texts of one size are sorted side by side.
    """
    def batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "start", "stop"])

    def sorted_out(groups: list[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for size, group in sorted(groups, key=lambda g: -g[0]):
            if some and held + size > BATCH:
                yield batch(repeats(some))
                some, held = [], 0
            some.append(group)
            held += size
        if some:
            yield batch(repeats(some))

    groups, copies, held, now, own = [], [], 0, None, {}

    def close() -> int:
        """Keeps what has several parts, and tells their bytes."""
        if len(own) < 2:
            return 0
        size = sum(map(len, own)) + len(own)
        groups.append((size, [(doc, at, raw) for raw, (doc, at) in own.items()]))
        return size

    for b in batches:
        for h, doc, at, raw in zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "at", "bytes")), strict=True):
            if h != now:
                held += close()
                now, own = h, {}
                if held > POOL:
                    yield from sorted_out(groups)
                    groups, held = [], 0
            if raw in own:
                copies.append((doc, at, at + len(raw)))
                if len(copies) > 100_000:
                    yield batch(copies)
                    copies = []
            else:
                own[raw] = (doc, at)
    close()
    if copies:
        yield batch(copies)
    yield from sorted_out(groups)


def repeated_ranges(docs: DataFrame, stages: Stages) -> DataFrame:
    """(doc_id, starts, stops, more_starts, more_stops) of bytes to remove; ranges of a document may overlap."""
    parts = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART

    def gathered(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part")

    found = gathered(docs.mapInArrow(_found(parts), "part int, c0 binary, c1 binary, r0 binary, r1 binary, r2 binary"))
    again = gathered(found.mapInArrow(_again(parts), "part int, c0 binary, c1 binary, c2 binary, c3 binary"))
    marks = stages.write(again.mapInArrow(_marks, MARKS), "marks")
    wanted = marks.where(F.size("at") > 0).select("doc_id", "at", "until", "anchor")
    rows = docs.join(wanted, "doc_id").select("doc_id", "text", "at", "until", "anchor").mapInArrow(_stretches, STRETCH)
    near = rows.repartition("h").sortWithinPartitions("h", "doc_id", "at").mapInArrow(_sorted_groups, "doc_id long, start int, stop int")
    near = stages.write(near.groupBy("doc_id").agg(F.collect_list("start").alias("more_starts"), F.collect_list("stop").alias("more_stops")), "near")
    return marks.select("doc_id", "starts", "stops").join(near, "doc_id", "full")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, runs, kept = [], [], [], []
        for text, *ranges in zip(*(b.column(c) for c in ("text", "starts", "more_starts", "stops", "more_stops")), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
            starts, stops = (np.concatenate([x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in pair]) for pair in (ranges[:2], ranges[2:]))
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, stops, -1)
            out = np.cumsum(edge)[:-1] > 0
            n.append(len(raw))
            gone.append(int(out.sum()))
            runs.append(int((out & ~np.concatenate([[False], out[:-1]])).sum()) if len(out) else 0)
            kept.append(raw[~out].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that stay; a cut may fall inside a character."""
    stages = Stages(docs.sparkSession, "suffix-dedup")
    docs = one_row_per_id(docs, id_col, text_col)
    out = docs.join(repeated_ranges(docs, stages), "doc_id", "left").select("doc_id", "text", "starts", "stops", "more_starts", "more_stops")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
