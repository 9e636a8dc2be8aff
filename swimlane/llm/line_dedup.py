"""Line dedup by winnowing over line hashes.

Method: a text is a sequence of lines: its physical lines, cut further after a
sentence's end, so that passages inside long lines line up too.  At each line
begins a gram, the fewest lines with ``noise_words`` words.  Winnowing takes, of
all grams that begin within ``window_words`` words of each other, the one of the
smallest hash; so any repeated passage of whole lines with
``noise_words + window_words`` words has a fingerprint in common with its
earlier copy.  Positions of equal fingerprints are joined, the match with the
first document that has it is extended line by line both ways, and the lines of
every later run are deleted; within one document, later repeats of a gram are
found in the same way.  The whole text is one more fingerprint, so that nothing is
left of a copy.

Plan: the texts go once through a kernel that emits a fingerprint's hash, place
and a few neighbouring line hashes (no text).  The places of a hash are brought together and sorted by
document, and a running window, which holds none of them, hands each the first one's neighbours; a hash that very many documents
have is thus one task's, which spills.  The runs to delete are gathered by document
and joined back, and the texts are cut in a second pass.  Grams have 64-bit hashes and neighbours 32-bit ones; texts
are not compared again (of a million million fingerprints some ten thousand would meet by chance).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import fresh, id_text
from .textkernel import Chunk, chunks, first_of_rows, mix

NOISE_WORDS = 20
WINDOW_WORDS = 20


class Lines:
    """The lines of a chunk: byte spans with their separators, word counts, hashes and grams."""

    def __init__(self, chunk: Chunk, noise: int, window: int):
        self.noise, self.window = noise, window
        d = chunk.data
        n = len(d)
        ws, we = chunk.words()
        # a line ends with the token that has a line feed, or follows a sentence's end, before the next token
        after = np.zeros(n + 1, np.int64)
        np.cumsum(d == 10, out=after[1:])
        rows = chunk.row_of(ws)
        head = np.ones(len(ws), bool)
        if len(ws) > 1:
            last = d[we[:-1] - 1]
            stop = (last == 46) | (last == 33) | (last == 63)
            head[1:] = (rows[1:] != rows[:-1]) | stop | (after[ws[1:]] > after[we[:-1]])
        at = np.flatnonzero(head)
        self.words = np.diff(np.append(at, len(ws)))
        self.row = rows[at]
        self.begin = ws[at]
        m = len(at)
        self.n = m
        # a line's hash is that of its words, so white space does not matter
        h = chunk.hashes(ws, we)
        sums = np.zeros(len(ws) + 1, np.uint64)
        turn = (np.arange(len(ws)) - np.repeat(at, self.words)).astype(np.uint64) if m else np.zeros(0, np.uint64)
        np.cumsum(mix(h + turn * np.uint64(0xD1B54A32D192ED03)), out=sums[1:])
        ends = at + self.words
        self.hash = mix(sums[ends] - sums[at])
        # grams: the fewest lines from each one on with enough words
        total = np.zeros(m + 1, np.int64)
        np.cumsum(self.words, out=total[1:])
        self.total = total
        self.row_end = np.searchsorted(self.row, self.row, side="right")
        self.gram_end = np.searchsorted(total, total[:-1] + noise, side="left")
        self.whole = self.gram_end <= self.row_end
        g = np.zeros(m, np.uint64)
        width = np.where(self.whole, self.gram_end - np.arange(m), 0)
        for k in range(int(width.max()) if m else 0):
            more = np.flatnonzero(width > k)
            g[more] = mix(g[more] * np.uint64(0x9FB21C651E98DF25) + self.hash[more + k])
        self.gram = g
        # winnowing: the smallest gram of each window, the first of equals
        reach = np.minimum(np.searchsorted(total, total[:-1] + window, side="left"), self.row_end)
        pick = np.zeros(m, bool)
        best, where = np.where(self.whole, g, np.uint64(2**64 - 1)), np.arange(m)
        low, spot = best.copy(), where.copy()
        span = reach - where
        ok = self.whole.copy()  # windows that hold whole grams only
        for k in range(1, int(span.max()) if m else 0):
            more = np.flatnonzero(span > k)
            ok[more] &= self.whole[more + k]
            less = more[best[more + k] < low[more]]
            low[less], spot[less] = best[less + k], less + k
        pick[spot[ok]] = True
        # a text too short for a window, and a text's end, still give their smallest gram
        tail = np.flatnonzero(self.whole & ~ok)
        if len(tail):
            order = np.lexsort((tail, g[tail], self.row[tail]))
            pick[tail[order][first_of_rows(self.row[tail[order]])]] = True
        self.pick = np.flatnonzero(pick)

    def contexts(self, picks: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """32-bit hashes of the lines before each gram, nearest first, and of those after it, as far as a window reaches."""
        e = self.gram_end[picks]
        row0 = np.searchsorted(self.row, self.row[picks], side="left")
        low = np.maximum(np.searchsorted(self.total, self.total[picks] - self.window, side="right") - 1, row0)
        high = np.minimum(np.searchsorted(self.total, self.total[e] + self.window, side="left"), self.row_end[picks])
        return self._packed(picks - 1, picks - low, -1), self._packed(e, high - e, 1)

    def whole_texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text with enough words for a gram: its first line, the end of its lines, the hash of all of them."""
        first = first_of_rows(self.row)
        last = np.append(first[1:], self.n)
        place = (np.arange(self.n) - np.repeat(first, last - first)).astype(np.uint64)
        h = np.add.reduceat(mix(self.hash + place * np.uint64(0xC2B2AE3D27D4EB4F)), first) if self.n else self.hash
        enough = self.total[last] - self.total[first] >= self.noise
        return first[enough], last[enough], mix(h[enough] + np.uint64(1))

    def _packed(self, at: np.ndarray, count: np.ndarray, step: int) -> pa.Array:
        ends = np.cumsum(count)
        nth = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
        flat = self.hash[np.repeat(at, count) + step * nth].astype(np.uint32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((4 * np.concatenate(([0], ends))).astype(np.int32)), pa.py_buffer(flat)])


def own_repeats(lines: Lines) -> np.ndarray:
    """Lines that a later repeat, within one text, of a gram covers; runs do not overlap the copy they repeat."""
    gone = np.zeros(lines.n, bool)
    i = np.flatnonzero(lines.whole)
    if len(i) < 2:
        return gone
    order = np.lexsort((i, lines.gram[i], lines.row[i]))
    i = i[order]
    new = np.concatenate(([True], (lines.gram[i[1:]] != lines.gram[i[:-1]]) | (lines.row[i[1:]] != lines.row[i[:-1]])))
    group = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
    first = i[group]
    later = ~new & (i >= lines.gram_end[first])
    marks = np.zeros(lines.n + 1, np.int64)
    np.add.at(marks, i[later], 1)
    np.add.at(marks, lines.gram_end[i[later]], -1)
    return np.cumsum(marks[:-1]) > 0


def fingerprints(docs: DataFrame, noise_words: int = NOISE_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(h, doc_id, tk, first, last, before, after) from (doc_id, text, tk): each fingerprint at its first place in a text, its lines [first, last), and the hashes of the lines around it."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(1)):
                x = Lines(c, noise_words, window_words)
                p = x.pick
                if not len(p):
                    continue
                order = np.lexsort((p, x.gram[p], x.row[p]))
                q = p[order]
                p = np.sort(q[np.concatenate(([True], (x.gram[q[1:]] != x.gram[q[:-1]]) | (x.row[q[1:]] != x.row[q[:-1]])))])
                row0 = np.searchsorted(x.row, x.row[p], side="left")
                a, z, all_ = x.whole_texts()
                yield pa.RecordBatch.from_arrays([pa.array(all_.view(np.int64)), pa.array(ids[c.first + x.row[a]]), pa.array(keys[c.first + x.row[a]]), pa.array(np.zeros(len(a), np.int32)), pa.array((z - a).astype(np.int32)), *(pa.array([b""] * len(a), pa.binary()),) * 2], schema=schema)
                before, after = x.contexts(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.gram[p].view(np.int64)), pa.array(ids[c.first + x.row[p]]), pa.array(keys[c.first + x.row[p]]), pa.array((p - row0).astype(np.int32)), pa.array((x.gram_end[p] - row0).astype(np.int32)), before, after],
                    schema=schema,
                )

    return docs.select("doc_id", "text", "tk").mapInArrow(run, "h long, doc_id long, tk long, first int, last int, before binary, after binary")


def _extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tk, first, last) of the run that each later place shares with the first document."""

    def same(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b)) // 4
        if a[: 4 * n] == b[: 4 * n]:
            return n
        k = 0
        while a[4 * k : 4 * k + 4] == b[4 * k : 4 * k + 4]:
            k += 1
        return k

    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    for b in batches:
        before = np.array([same(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(6).to_pylist())], np.int32)
        after = np.array([same(x, y) for x, y in zip(b.column(5).to_pylist(), b.column(7).to_pylist())], np.int32)
        first, last = b.column(2).to_numpy(), b.column(3).to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((first - before).astype(np.int32)), pa.array((last + after).astype(np.int32))], schema=schema)


def repeated_runs(docs: DataFrame, noise_words: int = NOISE_WORDS, window_words: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, first, last): runs of lines [first, last) that a document of a smaller id has already."""
    base = id_text(docs, id_col, text_col).where("doc_id is not null").withColumn("tk", F.xxhash64("text"))
    prints = fingerprints(base, noise_words, window_words)
    order = Window.partitionBy("h").orderBy("doc_id", "tk")
    of = lambda c: F.first(c).over(order)  # noqa: E731  the frame up to the row streams, it holds no group in memory
    seen = prints.select("doc_id", "tk", "first", "last", "before", "after", of("doc_id").alias("d0"), of("before").alias("before0"), of("after").alias("after0"))
    later = seen.where("doc_id > d0").select("doc_id", "tk", "first", "last", "before", "after", "before0", "after0")
    return later.mapInArrow(_extend, "doc_id long, tk long, first int, last int")


def dedup_lines(docs: DataFrame, noise_words: int = NOISE_WORDS, window_words: int = WINDOW_WORDS, drop_emptied: bool = True, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with later repeated runs deleted from their texts; all columns stay, and ``length_col``, if there is one, is the new length.

    "Later" goes by the id, and within a text by place.  Documents nothing of
    which remains are copies and go, unless ``drop_emptied`` is false.  Rows that
    share an id are one document and do not count as copies of each other.
    Null and empty texts, and rows whose id is null, come back as they are; texts
    under ``noise_words`` words hold no gram and never change.
    """
    tk, cut, r_id, r_tk = (fresh(docs, f"swl_{c}") for c in ("tk", "cut", "r_id", "r_tk"))
    runs = repeated_runs(docs, noise_words, window_words, id_col, text_col)
    cuts = runs.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("first", "last")).alias("runs")).select(F.col("doc_id").alias(r_id), F.col("tk").alias(r_tk), F.transform("runs", lambda r: r["first"].cast("long") * F.lit(1 << 32) + r["last"]).alias(cut))
    left = docs.withColumn(tk, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    joined = left.join(cuts, (F.col(id_col).cast("long") == F.col(r_id)) & (F.col(tk) == F.col(r_tk)), "left").select(*docs.columns, cut)
    at, named, schema = docs.columns.index(text_col), docs.columns.index(id_col), docs.schema
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.columns[:-1]
            new, keep = cut_texts(b.column(at), b.column(b.num_columns - 1), cols[named].is_valid(), noise_words, window_words)
            if new is not None:
                cols[at] = pa.array(new, cols[at].type)
                if length is not None:
                    old = cols[length]
                    before = b.column(at).to_pylist()
                    cols[length] = pa.array([o if x is y or x == y else len(y) for o, x, y in zip(old.to_pylist(), before, new)], old.type)
            out = pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])
            yield out.filter(pa.array(keep)) if drop_emptied and not keep.all() else out

    return joined.mapInArrow(run, schema)


def cut_texts(texts: pa.Array, cuts: pa.Array, named: pa.Array, noise: int, window: int) -> tuple[list | None, np.ndarray]:
    """The texts without the given runs and their own repeats (None if all stay as they are), and which of them have anything left or had nothing."""
    keep = np.ones(len(texts), bool)
    named_ = named.to_numpy(zero_copy_only=False)
    new = None
    have = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
    for c in chunks(texts):
        x = Lines(c, noise, window)
        gone = own_repeats(x)
        here = have[(have >= c.first) & (have < c.first + c.rows)]
        lows = np.searchsorted(x.row, here - c.first, side="left")
        for r, low in zip(here.tolist(), lows.tolist()):
            for run in cuts[r].as_py():
                gone[low + (run >> 32) : low + (run & 0xFFFFFFFF)] = True
        gone &= named_[c.first + x.row] if x.n else True
        hit = np.unique(x.row[gone])
        if len(hit) and new is None:
            new = texts.to_pylist()
        for r in hit.tolist():
            a, z = np.searchsorted(x.row, [r, r + 1])
            stay = np.flatnonzero(~gone[a:z]) + a
            if not len(stay):
                new[c.first + r], keep[c.first + r] = "", False
                continue
            start = x.begin[a:z].copy()
            start[0] = c.offsets[r]
            end = np.append(start[1:], c.offsets[r + 1])
            parts = [c.data[start[i - a] : end[i - a]] for i in stay.tolist()]
            new[c.first + r] = b"".join(p.tobytes() for p in parts).decode("utf-8", "replace").rstrip()
    return new, keep
