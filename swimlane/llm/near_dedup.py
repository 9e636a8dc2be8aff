"""SimHash near-duplicates by deletion-variant signatures.

Method: a document's signature has 128 bits, each the majority over its distinct
tokens.  It is cut into eleven segments; two signatures that differ in at most
21 bits differ by at most one bit in some segment (eleven segments with two
or more would make 22).  Each segment is indexed once for each of its bits, that
bit deleted, so segments one bit apart meet in an equality join; what meets is
verified by the distance over all 128 bits.  No pair within 21 bits is lost
and none beyond is kept.  Fewer segments have longer keys and so fewer chance
meetings in a larger corpus, but find only nearer copies (``segments``: 4 finds 7 bits).

Plan: equal signatures are first collapsed to one row, so exact copies cost
nothing further.  Variants carry two longs and an id, no text; they are
partitioned by key and sorted, and a streaming kernel verifies each key's
members against each other, larger groups in tiles (where a group's members are mostly near
each other it emits a spanning forest instead of all pairs, which connects the same members).  Groups are the connected components of verified
pairs, by alternating large-star and small-star rounds cut with checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import checkpoint, fresh, id_text
from .textkernel import Chunk, chunks, first_of_rows, mix

SEGMENTS = 11
_LANES = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.uint8).reshape(256, 8).copy().view(np.uint64)[:, 0]
_U = np.uint64


def distinct_tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 44-bit token hashes, each token once a row, sorted by row."""
    s, e = chunk.words()
    key = (chunk.row_of(s).astype(np.uint64) << _U(44)) | (chunk.hashes(s, e) >> _U(20))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1)


def simhash(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a token, and their signatures as (n, 2) words of 64 bits; a bit is set if more than half of the tokens have it."""
    rows, token = distinct_tokens(chunk)
    if not len(rows):
        return rows, np.zeros((0, 2), np.uint64)
    h = np.stack((mix(token * _U(0x2545F4914F6CDD1D) + _U(1)), mix(token * _U(0x9E6C63D0876A9A47) + _U(7))), axis=1)
    lanes = _LANES[h.view(np.uint8)]  # (tokens, 16): eight one-byte counters each
    starts = first_of_rows(rows)
    sizes = np.diff(np.append(starts, len(rows)))
    # no counter may pass 255: longer rows are summed in parts
    parts = -(-sizes // 255)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - first)
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 128)
    sums = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    bits = np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little")
    return rows[starts], np.ascontiguousarray(bits).view(np.uint64)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, s0, s1) of every text with a token and an id; tk is the text's hash."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "tk", "s0", "s1")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tk = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for c in chunks(b.column(1)):
                rows, sig = simhash(c)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[c.first + rows], tk[c.first + rows], sig[:, 0].view(np.int64), sig[:, 1].view(np.int64))], schema=schema)

    texts = id_text(docs, id_col, text_col).where("doc_id is not null").withColumn("tk", text_hash("text"))
    return texts.mapInArrow(run, "doc_id long, tk long, s0 long, s1 long")


def segment(s: np.ndarray, low: int, width: int) -> np.ndarray:
    """Bits [low, low + width) of (n, 2) signatures."""
    if low >= 64:
        x = s[:, 1] >> _U(low - 64)
    elif low + width <= 64:
        x = s[:, 0] >> _U(low)
    else:
        x = (s[:, 0] >> _U(low)) | (s[:, 1] << _U(64 - low))
    return x & _U((1 << width) - 1)


def widths(segments: int) -> list[int]:
    """128 bits in segments as equal as can be."""
    if not 4 <= segments <= 16:
        raise ValueError("4 to 16 segments")
    return [128 // segments + (i < 128 % segments) for i in range(segments)]


def variants(s: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """(n, 128) keys: segment and deleted bit, and the bits that remain."""
    out, low, nth = [], 0, 0
    for width in widths(segments):
        x = segment(s, low, width)
        for p in range(width):
            rest = (x & _U((1 << p) - 1)) | ((x >> _U(p + 1)) << _U(p))
            out.append((_U(nth) << _U(32)) | rest)
            nth += 1
        low += width
    return np.stack(out, axis=1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which signatures differ."""
    x = a ^ b
    return np.bitwise_count(x[..., 0]).astype(np.int64) + np.bitwise_count(x[..., 1])


def forest(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all members within ``most`` bits of each other just as all such pairs would."""
    rest, a, b = np.arange(len(s)), [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = apart(s[at], s[rest]) <= most
            if near.any():
                hit = rest[near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                queue += hit.tolist()
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def close_pairs(s: np.ndarray, most: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs within ``most`` bits of each other, or None if they are more than eight a member."""
    a, b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    words = [np.ascontiguousarray(s[:, k]) for k in (0, 1)]
    for i in range(0, len(s), tile):
        for j in range(i, len(s), 4 * tile):
            # few chance meetings pass on the first word
            at = np.flatnonzero(np.bitwise_count(words[0][i : i + tile, None] ^ words[0][None, j : j + 4 * tile]) <= most)
            x, y = np.divmod(at, min(4 * tile, len(s) - j))
            x, y = x + i, y + j
            near = (x < y) & (apart(s[x], s[y]) <= most)
            a.append(x[near])
            b.append(y[near])
            n += len(a[-1])
            if n > 8 * len(s):
                return None
    return np.concatenate(a), np.concatenate(b)


def first_key(x: np.ndarray, segments: int) -> np.ndarray:
    """Of differences of signatures: the number of the first deletion under which the two meet, of a pair that meets at all."""
    out, low = np.full(len(x), -1), 0
    for width in widths(segments):
        part = segment(x, low, width)
        ones = np.bitwise_count(part)
        hit = (out < 0) & (ones <= 1)
        out[hit] = low + np.where(ones[hit] == 1, np.bitwise_count(part[hit] - (ones[hit] == 1)), 0)
        low += width
    return out


def key_pairs(key: np.ndarray, s: np.ndarray, segments: int = SEGMENTS, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the distance among rows of equal keys, the keys sorted: all pairs that meet under no earlier one; where many share a key and are mostly near each other, a forest."""
    n, most = len(key), 2 * segments - 1
    starts = first_of_rows(key)
    sizes = np.diff(np.append(starts, n))
    size = np.repeat(sizes, sizes)
    a, b = [], []
    for d in range(1, min(small, int(sizes.max(initial=1)))):
        i = np.flatnonzero((key[d:] == key[:-d]) & (size[:-d] <= small))
        i = i[np.bitwise_count(s[i, 0] ^ s[i + d, 0]) <= most]
        i = i[apart(s[i], s[i + d]) <= most]
        i = i[first_key(s[i] ^ s[i + d], segments) == key[i] >> 32]
        a.append(i)
        b.append(i + d)
    for g in np.flatnonzero(sizes > small).tolist():
        lo, hi = starts[g], starts[g] + sizes[g]
        if near := close_pairs(s[lo:hi], most):
            x, y = near
            first = first_key(s[lo + x] ^ s[lo + y], segments) == key[lo] >> 32
            x, y = x[first], y[first]
        else:
            x, y = forest(s[lo:hi], most)
        a.append(lo + x)
        b.append(lo + y)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_pairs(distinct: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(u, v): verified pairs of (node, s0, s1), enough to connect what all pairs connect.

    Variants carry the signature and no id, as they are most of what is moved.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                s0, s1 = (part.column(i).to_numpy() for i in range(2))
                keys = variants(np.stack((s0, s1), axis=1).view(np.uint64), segments)
                k = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(pa.array(np.repeat(x, k)) for x in (s0, s1))], schema=schema)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("a0", "a1", "b0", "b1")])
        held: list[tuple] = []

        def pairs(cols: tuple) -> pa.RecordBatch | None:
            s = np.stack(cols[1:], axis=1)
            a, b = key_pairs(cols[0], s.view(np.uint64), segments)
            if not len(a):
                return None
            return pa.RecordBatch.from_arrays([pa.array(s[i, k].copy()) for i in (a, b) for k in (0, 1)], schema=schema)

        for b in batches:  # sorted by key; the last key's rows wait for the next batch
            if not b.num_rows:
                continue
            now = tuple(b.column(i).to_numpy() for i in range(3))
            if held and now[0][-1] == held[0][0][0]:
                held.append(now)
                continue
            cols = tuple(map(np.concatenate, zip(*held, now))) if held else now
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            held = [tuple(x[cut:] for x in cols)]
            if cut and (out := pairs(tuple(x[:cut] for x in cols))) is not None:
                yield out
        if held and (out := pairs(tuple(map(np.concatenate, zip(*held))))) is not None:
            yield out

    keyed = distinct.select("s0", "s1").mapInArrow(emit, "key long, s0 long, s1 long")
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a0 long, a1 long, b0 long, b1 long")
    of = lambda x, node: distinct.select(F.col("s0").alias(f"{x}0"), F.col("s1").alias(f"{x}1"), F.col("node").alias(node))
    return met.join(of("a", "u"), ["a0", "a1"]).join(of("b", "v"), ["b0", "b1"]).select("u", "v")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node in a pair (u, v).

    A node's smallest neighbour is a combined aggregate that is joined back, so a node
    with very many neighbours is no single task's.  The rounds end when one changes no edge.
    """
    edges = checkpoint(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("m", F.explode(F.array("u", "v")).alias("u")).where("u <> m").select("u", F.col("m").alias("v")).distinct()
        new = checkpoint(small)
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = new
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, segments: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tk, kept_id) of every text with a token and an id; tk is the text's hash."""
    sig = checkpoint(signatures(docs, id_col, text_col))
    # a number of its own for each signature: an id may have several
    distinct = checkpoint(sig.groupBy("s0", "s1").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    roots = components(near_pairs(distinct, segments))
    nodes = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = nodes.groupBy("root").agg(F.min("first").alias("kept_id"))
    return sig.join(nodes.join(kept, "root").select("s0", "s1", "kept_id"), ["s0", "s1"]).select("doc_id", "tk", "kept_id")


def near_duplicates(docs: DataFrame, segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_id): each document that goes, with the one of its group that stays, the smallest id.

    Groups are connected by signatures at most ``2 * segments - 1`` of 128 bits apart.  Null, empty
    and blank texts have no signature and no group; a null id is left out; rows
    that share an id and a text are named once, an id with several texts once for each group that one of them
    leaves (its other texts are not concerned); an empty table gives an empty result.
    """
    return _grouped(docs, segments, id_col, text_col).where("doc_id <> kept_id").select("doc_id", "kept_id").distinct()


def drop_near_duplicates(docs: DataFrame, segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns.

    A row goes if its text's group has a smaller id; rows of the group's smallest id stay.  Of rows
    that share an id and a text one stays, that of the smallest hash of all its columns (columns of maps aside); null ids
    and texts without a token stay.
    """
    gone_id, gone_tk, tk, h, nth = (fresh(docs, f"swl_{c}") for c in ("gone_id", "gone_tk", "tk", "h", "nth"))
    gone = _grouped(docs, segments, id_col, text_col).where("doc_id <> kept_id").select(F.col("doc_id").alias(gone_id), F.col("tk").alias(gone_tk)).distinct()
    whole = F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t and "variant" not in t))
    # the rows are put together by id and text once, for both steps
    rows = docs.withColumn(tk, text_hash(text_col)).withColumn(h, whole)
    first = rows.withColumn(nth, F.row_number().over(Window.partitionBy(id_col, tk).orderBy(h))).where(F.col(id_col).isNull() | (F.col(nth) == 1))
    return first.join(gone, (F.col(id_col).cast("long") == F.col(gone_id)) & (F.col(tk) == F.col(gone_tk)), "left_anti").select(*docs.columns)
