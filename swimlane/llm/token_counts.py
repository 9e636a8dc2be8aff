"""Token counts by a map-side two-tier lookup.

Method: a byte-level BPE counts each pre-token by itself, and a cut before a
space that a non-space follows is always a cut between pre-tokens; so a text's
count is the sum over its chunks between such spaces, and a chunk's count never
depends on its neighbours.  A compact table of the corpus's frequent chunks and
their lengths is broadcast; a chunk outside it is encoded once by each worker
and kept in the worker's cache, which outlives its tasks.  Texts with a space before other white space, or at
their end, are pre-tokenised as a whole.

Plan: pass one finds in each partition the chunks above a share of its own
and adds up these few; the table
keeps the most frequent of them and has a fixed bound.  It need not hold every frequent chunk: a
miss costs time and changes no count.
Pass two counts; neither shuffles pre-tokens.
"""

from __future__ import annotations

import ast
import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import id_text
from .textkernel import buffers, strings

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARE = 2e-5
TABLE = 1 << 15
CACHE = 1 << 19
#: The published pre-tokenisation pattern of the byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pattern(path: str) -> str:
    """The pre-tokenisation pattern that a module beside the vocabulary file states (it is read, not run), else the published one."""
    beside = Path(path).with_name("__init__.py")
    for node in ast.parse(beside.read_text(encoding="utf-8")).body if beside.exists() else []:
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and any(getattr(t, "id", "") == "PATTERN" for t in node.targets):
            return str(node.value.value)
    return PATTERN


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern(path), mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def parts(array: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``most`` bytes and where they begin."""
    _, off = buffers(array)
    i = 0
    while i < len(array):
        j = min(len(array), max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1))
        yield i, array.slice(i, j - i)
        i = j


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Which texts are safe to cut; text numbers, distinct chunks and their numbers, a later chunk with its space in front."""
    safe = pc.invert(pc.match_substring_regex(texts, r" (?:[\s\v\p{Z}\x{85}\x1c-\x1f]|$)")).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(safe)
    pieces = pc.split_pattern(texts.take(pa.array(at)), " ")
    off = pieces.offsets.to_numpy()
    coded = pieces.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    first = np.zeros(len(code), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    # the same string with and without a space before it are two chunks
    code = code.astype(np.int64) * 2 + ~first
    used, code = np.unique(code, return_inverse=True)
    base = coded.dictionary.take(pa.array(used >> 1))
    chunks = pc.if_else(pa.array(used & 1 == 1), pc.binary_join_element_wise(pa.scalar(""), base, " "), base)
    return at, np.repeat(np.arange(len(at)), np.diff(off)), chunks, code


def frequent_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, share: float = SHARE, table: int = TABLE) -> dict[str, int]:
    """At most ``table`` chunks, the most frequent over all documents, with their token counts."""
    schema = pa.schema([("chunk", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        total, floor = 0, 0
        for b in batches:
            for _, part in parts(strings(b.column(0))):
                _, _, chunks, code = split(part)
                n = np.bincount(code, minlength=len(chunks))
                total += len(code)
                often = np.flatnonzero(n >= 3)
                for c, k in zip(chunks.take(pa.array(often)).to_pylist(), n[often].tolist()):
                    counts[c] = counts.get(c, 0) + k
                if len(counts) > 4 * CACHE:  # a summary only; what it loses is encoded in the second pass
                    floor += 3
                    counts = {c: k for c, k in counts.items() if k > floor}
        out = [(c, k) for c, k in counts.items() if k >= max(3, share * total)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([k for _, k in out], pa.int64())], schema=schema)

    top = docs.select("text").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(table).collect()
    e = encoder(tokenizer)
    return {r.chunk: len(e.encode_ordinary(r.chunk)) for r in top}


_CACHES: dict[str, dict[str, int]] = {}


class Counter:
    """The table first, then the worker's cache, then the encoder."""

    def __init__(self, table: dict[str, int], tokenizer: str):
        self.table, self.cache = table, _CACHES.setdefault(tokenizer, {})
        e = encoder(tokenizer)
        self.encode = e.encode_ordinary
        self.bytes = np.zeros(e.n_vocab, np.int64)
        for token, rank in e._mergeable_ranks.items():
            self.bytes[rank] = len(token)

    def many(self, chunks: list[str]) -> list[int]:
        """Counts of chunks outside the table and the cache.  Those that begin with a space and a non-space are encoded in one string, which no token crosses."""
        out = [0] * len(chunks)
        joined = [i for i, c in enumerate(chunks) if len(c) > 1 and c[0] == " " and not c[1].isspace()]
        ids = np.array(self.encode("".join([chunks[i] for i in joined])), np.int64)
        ends = np.cumsum(self.bytes[ids])
        at = np.searchsorted(ends, np.cumsum([len(chunks[i].encode()) for i in joined]), side="right")
        for i, n in zip(joined, np.diff(at, prepend=0).tolist()):
            out[i] = n
        for i in set(range(len(chunks))) - set(joined):
            out[i] = len(self.encode(chunks[i]))
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        at, own, chunks, code = split(texts)
        keys = chunks.to_pylist()
        table, cache = self.table.get, self.cache.get
        n = [table(c) or cache(c) for c in keys]
        if missing := [i for i, x in enumerate(n) if x is None]:
            if len(self.cache) > CACHE:
                self.cache.clear()
            for i, x in zip(missing, self.many([keys[i] for i in missing])):
                n[i] = x
                if len(keys[i]) <= 64:
                    self.cache[keys[i]] = x
        out[at] = np.bincount(own, weights=np.array(n, np.float64)[code] if n else None, minlength=len(at)).astype(np.int64)
        safe = np.zeros(len(texts), bool)
        safe[at] = True
        for i in np.flatnonzero(~safe).tolist():
            out[i] = len(self.encode(texts[i].as_py()))
        return out


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, share: float = SHARE, table: int = TABLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document that has an id: exactly what encoding its whole text gives.

    Null and empty texts count 0; repeated rows are repeated; special tokens'
    strings are ordinary text; an empty table gives an empty result.
    """
    base = id_text(docs, id_col, text_col).where("doc_id is not null")
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(base, tokenizer, share, table))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value, tokenizer)
        for b in batches:
            for i, part in parts(strings(b.column(1))):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array(counter.texts(part))], schema=schema)

    return base.mapInArrow(run, "doc_id long, n_tokens long")
