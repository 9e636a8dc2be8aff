"""Best-fit packing of documents into training sequences.

Method: hierarchical residual packing.  Texts are measured in white-space
tokens, or, with a ``tokenizer``, in those of its vocabulary; one longer than a bin is cut into full bins and a rest.  Pieces are
spread over groups, each group packs its pieces best-fit, largest first, and
emits the bins that are nearly full.  Underfull bins become the items of the
next round, in fewer groups, as up a tree, until one group is left or a round
merges none.

Plan: a round's groups hold about ``group_tokens`` tokens, so no task grows with
the corpus; what moves is ids and lengths, never text.  Groups go by a hash of the
item, so a lost task repeats its work exactly.  Each round is cut by a checkpoint.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import checkpoint, id_text
from .textkernel import chunks
from .token_counts import token_counts

CAPACITY = 2048
NEARLY_FULL = 0.98
GROUP_TOKENS = 8 << 20


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices: items from the largest on, each into the fullest bin that has room, else a new one; earlier indices and bins first among equals."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > sizes[i]:
            insort(rooms, (room - sizes[i], b))
    return bins


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n): tokens of each text that has any, between white space or of a vocabulary."""
    if tokenizer:
        return token_counts(docs, tokenizer, id_col=id_col, text_col=text_col).select("doc_id", F.col("n_tokens").alias("n")).where("n > 0")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                n = np.bincount(c.row_of(c.words()[0]), minlength=c.rows)
                out = pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.rows), pa.array(n)], schema=schema)
                yield out.filter(pa.array(n > 0))

    return id_text(docs, id_col, text_col).where("doc_id is not null").mapInArrow(run, "doc_id long, n long")


_PIECES = "array<struct<doc_id: long, copy: int, start: long, n: int>>"


def pack(docs: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(pack_id, position, doc_id, copy, start, n_tokens, pack_tokens): every token of every document in one bin.

    A row is a piece: tokens [start, start + n_tokens) of the document, at
    ``position`` in its bin, which holds ``pack_tokens`` of at most ``capacity``.
    Pieces stand by document and start.  ``copy`` numbers rows that share an id,
    from 0, longer first; each is packed.  Null, empty and blank texts have no token and no
    piece; a null id is left out; an empty table gives an empty result.  ``tokenizer`` is the path
    of a vocabulary file as of ``token_counts``: lengths and capacity are then in its tokens.
    """
    n = lengths(docs, id_col, text_col, tokenizer)
    rows = n.withColumn("copy", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"))) - 1).cast("int"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))
    pieces = rows.select("doc_id", "copy", F.explode(starts).alias("start"), F.col("n").alias("of"))
    pieces = pieces.select("doc_id", "copy", "start", F.least(F.lit(capacity), F.col("of") - F.col("start")).cast("int").alias("n"))
    items = checkpoint(pieces.select(F.col("n").cast("long").alias("size"), F.array(F.struct("doc_id", "copy", "start", "n")).alias("pieces")))
    done, turn = [], 0
    while True:
        total, count = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        groups = max(1, -(-total // group_tokens))
        packed = checkpoint(_round(items, groups, turn, capacity, 0 if groups == 1 else int(nearly_full * capacity)))
        if groups == 1 or packed.count() == count:
            done.append(packed)
            break
        done.append(packed.where("full"))
        items, turn = packed.where("not full").select("size", "pieces"), turn + 1
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionAll(d)
    bins = bins.select(F.array_sort("pieces").alias("pieces"), F.col("size").alias("pack_tokens"))
    named = bins.select(F.concat_ws("-", F.col("pieces")[0]["doc_id"], F.col("pieces")[0]["copy"], F.col("pieces")[0]["start"]).alias("pack_id"), F.posexplode("pieces").alias("position", "p"), "pack_tokens")
    return named.select("pack_id", "position", F.col("p.doc_id").alias("doc_id"), F.col("p.copy").alias("copy"), F.col("p.start").alias("start"), F.col("p.n").alias("n_tokens"), "pack_tokens")


def _round(items: DataFrame, groups: int, turn: int, capacity: int, full: int) -> DataFrame:
    """(size, pieces, full): each group's bins, full from ``full`` tokens on."""
    first = F.col("pieces")[0]
    placed = items.withColumn("g", F.pmod(F.xxhash64(F.lit(turn), first["doc_id"], first["copy"], first["start"]), F.lit(groups)).cast("int"))
    kinds = pa.struct([("doc_id", pa.int64()), ("copy", pa.int32()), ("start", pa.int64()), ("n", pa.int32())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        sizes = t["size"].to_pylist()
        col = t["pieces"].combine_chunks()
        flat = col.flatten()
        cols = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
        off = col.offsets.to_numpy() - (col.offsets[0].as_py() if len(col) else 0)
        # a lost task must find its items in the same order again
        start = off[:-1]
        order = np.lexsort((cols[2][start], cols[1][start], cols[0][start]))
        bins = best_fit([sizes[i] for i in order.tolist()], capacity)
        take, ends, total = [], [0], []
        for b in bins:
            b = order[b].tolist()
            for i in b:
                take.append(np.arange(off[i], off[i + 1]))
            ends.append(ends[-1] + sum(int(off[i + 1] - off[i]) for i in b))
            total.append(sum(sizes[i] for i in b))
        at = np.concatenate(take) if take else np.zeros(0, np.int64)
        values = pa.StructArray.from_arrays([pa.array(c[at], type=f.type) for c, f in zip(cols, kinds)], fields=list(kinds))
        return pa.table([pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array([x >= full for x in total], pa.bool_())], names=["size", "pieces", "full"])

    return placed.groupBy("g").applyInArrow(run, f"size long, pieces {_PIECES}, full boolean")
