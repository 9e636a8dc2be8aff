"""Document fingerprints by Order MinHash.

Method: a text's k-mers are its runs of ``k`` tokens, each with the number of
its earlier occurrences in the text.  Each of ``m`` hash functions takes the
``l`` k-mers whose (k-mer, occurrence) hashes are smallest, puts them back in
text order and hashes that tuple.  The share of equal entries of two signatures
estimates a similarity that falls with the edit distance of the token sequences:
moved text changes the order of the tuples, repeated text their occurrence
numbers.

Plan: one pass without a shuffle, all hash functions vectorised over the texts
of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text
from .textkernel import Chunk, chunks, first_of_rows, mix

K, M, L = 2, 32, 2
_U = np.uint64
_MAX = _U(2**64 - 1)


def kmers(chunk: Chunk, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of k-mers in text order; a text under k tokens is one k-mer of all its tokens."""
    s, e = chunk.words()
    rows, h = chunk.row_of(s), chunk.hashes(s, e)
    if not len(rows):
        return rows, h
    start = first_of_rows(rows)
    size = np.diff(np.append(start, len(rows)))
    left = np.repeat(start + size, size) - np.arange(len(rows))  # tokens from here to the text's end
    out = np.zeros(len(h), np.uint64)
    for j in range(k):
        more = np.flatnonzero(left > j)
        out[more] = mix(out[more] * _U(0xA0761D6478BD642F) + h[more + j])
    whole = left >= k
    whole[start] = True
    return rows[whole], out[whole]


def occurrences(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each k-mer came before in its text."""
    key = (rows.astype(np.uint64) << _U(44)) | (h >> _U(20))
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    run = np.arange(len(key))
    run -= np.maximum.accumulate(np.where(new, run, 0))
    out = np.empty(len(key), np.int64)
    out[order] = run
    return out


def sketch(rows: np.ndarray, h: np.ndarray, m: int = M, l: int = L) -> np.ndarray:  # noqa: E741
    """(texts, m) signature entries of k-mers sorted by row."""
    start = first_of_rows(rows)
    size = np.diff(np.append(start, len(rows)))
    numbered = mix(h + mix(occurrences(rows, h).astype(np.uint64)))
    out = np.empty((len(start), m), np.uint64)
    for j in range(m):
        x = mix(numbered ^ mix(np.full(1, j + 1, np.uint64)))
        places = np.full((len(start), l), -1, np.int64)
        for n in range(l):
            low = np.minimum.reduceat(x, start)
            at = np.flatnonzero(x == np.repeat(low, size))
            own = np.searchsorted(start, at, side="right") - 1
            first = first_of_rows(own)
            own, at = own[first], at[first]
            fresh = size[own] > n  # a text of fewer k-mers gives the ones it has
            places[own[fresh], n] = at[fresh]
            x[at] = _MAX
        places.sort(axis=1)
        entry = np.zeros(len(start), np.uint64)
        for n in range(l):
            have = places[:, n] >= 0
            entry[have] = mix(entry[have] * _U(0xE7037ED1A0B428DB) + h[places[have, n]])
        out[:, j] = entry
    return out


def fingerprints(docs: DataFrame, k: int = K, m: int = M, l: int = L, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: E741
    """(doc_id, n_kmers, signature) of every document that has an id.

    The signature is an array of ``m`` longs.  A text without tokens (null, empty
    or blank) has no k-mer and an empty signature; one under k tokens has one
    k-mer, one under l k-mers makes its tuples of those it has.  Repeated rows are
    repeated, equal texts get equal signatures whatever the case of ASCII letters
    or the white space; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_kmers", pa.int32()), ("signature", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                rows, h = kmers(c, k)
                count = np.bincount(rows, minlength=c.rows).astype(np.int32)
                flat = sketch(rows, h, m, l).reshape(-1).view(np.int64) if len(rows) else np.zeros(0, np.int64)
                offsets = np.concatenate(([0], np.cumsum(np.where(count > 0, m, 0)))).astype(np.int32)
                sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.rows), pa.array(count), sig], schema=schema)

    return id_text(docs, id_col, text_col).where("doc_id is not null").mapInArrow(run, "doc_id long, n_kmers int, signature array<long>")
