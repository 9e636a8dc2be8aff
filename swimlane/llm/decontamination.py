"""Benchmark decontamination by pigeonhole edit matching.

Method: a test item of n normalised characters may be reproduced with at most
k = floor(max_error_rate * n) edits.  It is cut into k + 1 pieces, one of which
every such copy must hold unchanged; a table of all pieces by their first and last eight
bytes finds the exact piece hits, and each region they point to is verified with
Myers' bit-parallel edit distance against the whole item.  An item too short for
an edit (k = 0) is matched exactly, as whole words.

Plan: the table is built in each worker from the items of one shard; shards
hold at most ``shard_bytes`` of benchmark text, so what is sent to the workers
is checked and bounded (a worker holds about fifteen bytes for each of them), and a benchmark beyond it takes more passes over the
documents, with the same result.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, filter_by_text, id_text
from .textkernel import mix

MAX_ERROR_RATE = 0.06
MIN_CHARS = 1
SHARD_BYTES = 16 << 20
_U = np.uint64


def normalise(text: str) -> str:
    """Lower case, and every run of white space as one space."""
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the best approximate occurrence of the pattern in the text; the first end among equals."""
    m = len(pattern)
    masks = masks or char_masks(pattern)
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def windows(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as numbers; the data must have eight bytes more than places."""
    return np.ndarray((len(data) - 8,), "<u8", data, 0, (1,))


class Pieces:
    """Pieces by length, each found by a mix of its first and last eight bytes (or of all of them)."""

    def __init__(self, pieces: list[bytes]):
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size) - size
        w = windows(b"".join([*pieces, bytes(8)]))
        self.bits = min(28, (16 * len(pieces)).bit_length())  # one head in sixteen is there by chance
        self.heads, self.tables = np.zeros(1 << self.bits, bool), {}
        for n in np.unique(size).tolist():
            of = np.flatnonzero(size == n)
            key = self.keys(w, start[of], n)
            order = np.argsort(key, kind="stable")
            self.tables[n] = key[order], of[order]
            if n >= 8:
                self.heads[self.spread(w[start[of]])] = True

    def spread(self, head: np.ndarray) -> np.ndarray:
        return (head * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)

    @staticmethod
    def keys(w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        if n < 8:
            return mix(w[at] & _U((1 << 8 * n) - 1))
        return mix(w[at] ^ mix(w[at + (n - 8)]))

    def hits(self, data: bytes, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Places in the data (which ends in eight more bytes) and the pieces that stand there."""
        w, places, found = windows(data), [], []
        for low in range(0, len(w), step):
            here = w[low : low + step]
            likely = np.flatnonzero(self.heads[self.spread(here)]) + low
            for n, (key, of) in self.tables.items():
                at = likely if n >= 8 else np.arange(low, low + len(here))
                at = at[at + n <= len(w)]
                k = self.keys(w, at, n)
                first = np.searchsorted(key, k)
                some = np.flatnonzero(key[np.minimum(first, len(key) - 1)] == k)
                first = first[some]
                many = np.searchsorted(key, k[some], side="right") - first
                ends = np.cumsum(many)
                nth = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many, many)
                places.append(np.repeat(at[some], many))
                found.append(of[np.repeat(first, many) + nth])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64),) * 2


def joined(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word; scripts without spaces have no words in this sense."""
    return a.isalnum() and b.isalnum() and not any("\u0e00" <= c < "\u0f00" or "\u1000" <= c < "\u10a0" or "\u1780" <= c < "\u1800" or c >= "\u2e80" for c in (a, b))


class Matcher:
    """Items of one shard: their pieces in a table, their masks for verification."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = MIN_CHARS):
        self.items = sorted({(i, n) for i, t in items if len(n := normalise(t)) >= max(1, min_chars)})
        self.masks: dict[int, dict[str, int]] = {}
        self.budget = [int(rate * len(t)) for _, t in self.items]
        pieces, item, offset = [], [], []
        for at, ((_, t), k) in enumerate(zip(self.items, self.budget)):
            cuts = [len(t) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.append(t[a:b].encode("utf-8", "surrogatepass"))
                item.append(at)
                offset.append(a)
        self.item, self.offset = np.array(item, np.int32), np.array(offset, np.int32)
        self.pieces = Pieces(pieces) if pieces else None

    def many(self, raws: list[str], most: int = 2 << 20) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item_id, distance, start, end) for each item found, at its best place in the normalised text."""
        if self.pieces is None:
            return
        texts, held, first = [], 0, 0
        for n, raw in enumerate(raws):
            texts.append(normalise(raw))
            held += len(texts[-1])
            if held > most or n == len(raws) - 1:
                yield from self._found(texts, first)
                texts, held, first = [], 0, n + 1

    def _found(self, texts: list[str], first: int) -> Iterator[tuple[int, int, int, int, int]]:
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join([*coded, bytes(8)])  # no piece has a line feed
        place, piece = self.pieces.hits(data)
        if not len(place):
            return
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        start = np.cumsum(size + 1) - size - 1
        row = np.searchsorted(start, place, side="right") - 1
        if len(data) - 8 - len(texts) > sum(map(len, texts)):  # places in characters
            lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            before = np.concatenate(([0], np.cumsum(lead)))
            diagonal = before[place] - before[start[row]]
        else:
            diagonal = place - start[row]
        diagonal = diagonal - self.offset[piece]
        item = self.item[piece]
        order = np.lexsort((diagonal, item, row))
        row, item, diagonal = row[order], item[order], diagonal[order]
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]))))
        out = []
        for a, z in zip(new.tolist(), [*new[1:].tolist(), len(row)]):
            best = self.verify(texts[row[a]], int(item[a]), diagonal[a:z].tolist())
            if best:
                out.append((first + int(row[a]), self.items[item[a]][0], *best))
        yield from sorted(out)

    def verify(self, text: str, at: int, starts: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best copy of an item in the regions about some places, outside which no copy can lie."""
        pattern, k = self.items[at][1], self.budget[at]
        n = len(pattern)
        if not k:
            ends = lambda s: (s and joined(text[s - 1], pattern[0])) or (s + n < len(text) and joined(pattern[-1], text[s + n]))
            return next(((0, s, s + n) for s in starts if s >= 0 and text.startswith(pattern, s) and not ends(s)), None)
        merged: list[list[int]] = []
        for s in starts:
            a, b = max(0, s - k), min(len(text), s + n + k)
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            elif b > a:
                merged.append([a, b])
        best = None
        for a, b in merged:
            if b - a < n - k:
                continue
            d, end = myers(pattern, text[a:b], self._masks(at))
            if d <= k and (best is None or d < best[0]):
                best = (d, a, a + end)
        if best is None:
            return None
        d, a, end = best
        back = text[max(a, end - n - k) : end][::-1]
        return d, end - myers(pattern[::-1], back)[1], end

    def _masks(self, at: int) -> dict[str, int]:
        if at not in self.masks:
            if len(self.masks) > 4096:  # a cache only
                self.masks.clear()
            self.masks[at] = char_masks(self.items[at][1])
        return self.masks[at]


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: tuple, rate: float, min_chars: int) -> Matcher:
    key = (hash(items), len(items), rate, min_chars)
    if key not in _MATCHERS:
        _MATCHERS.clear()  # one shard at a time
        _MATCHERS[key] = Matcher(list(items), rate, min_chars)
    return _MATCHERS[key]


def shards(benchmark: DataFrame, shard_bytes: int, id_col: str, text_col: str) -> Iterator[tuple]:
    """The items in parts of about ``shard_bytes``, each of them read only when its turn comes."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // shard_bytes))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield tuple(sorted((r.item_id, r.text) for r in part.collect()))


def contaminated(docs: DataFrame, benchmark: DataFrame, max_error_rate: float = MAX_ERROR_RATE, min_chars: int = MIN_CHARS, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, match_start, match_end): every document and every item it holds.

    The place is that of the best copy (the first of equals), in characters of
    the normalised text.  Items of any length are searched (``min_chars`` can leave out short ones), those too short for an
    edit as whole words; one without a character matches nothing; items that share an id are all searched.  Null or
    empty texts match nothing, a null doc_id or item_id is left out, repeated
    rows are reported each, an empty table on either side gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("match_start", pa.int64()), ("match_end", pa.int64())])
    base = id_text(docs, id_col, text_col).where("doc_id is not null")
    out = None
    for items in shards(benchmark, shard_bytes, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = _matcher(sent.value, max_error_rate, min_chars)
            for b in batches:
                ids = b.column(0).to_pylist()
                found = [(ids[n], *x) for n, *x in m.many(b.column(1).to_pylist())]
                if found:
                    yield batch(schema, list(zip(*found)))

        part = base.mapInArrow(run, "doc_id long, item_id long, distance int, match_start long, match_end long")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_error_rate: float = MAX_ERROR_RATE, min_chars: int = MIN_CHARS, shard_bytes: int = SHARD_BYTES, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; null texts and null ids stay."""
    for items in shards(benchmark, shard_bytes, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def keep(texts: pa.Array, sent=sent) -> pa.Array:
            m = _matcher(sent.value, max_error_rate, min_chars)
            clean = np.ones(len(texts), bool)
            clean[[n for n, *_ in m.many(texts.to_pylist())]] = False
            return pa.array(clean)

        docs = filter_by_text(docs, keep, text_col)
    return docs
