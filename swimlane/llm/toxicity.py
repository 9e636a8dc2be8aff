"""Toxicity scores from misspelling-tolerant lexicon hits and their context.

Method: every token is a Levenshtein automaton (a bit-parallel NFA over the
token's positions) that is intersected with the lexicon's trie, so spelling
variants of a term are found in one walk.  A term of five letters or more may
be one edit away, but not in its first letter, which misspellings seldom touch;
a shorter one must be exact; look-alike digits and signs (``1d1ot``, ``$tupid``)
are folded first, and marks at a token's ends (``moron!!``) are read both as letters and as marks.  A lexicon entry that ends in
``*`` is a stem: it matches, unedited, at the beginning of a token.  Stems come
from ``learn_lexicon``, which fits a lexicon on a bounded sample of labelled
rows.  A hit is then weighed by the words
around it: quotation (paired marks, over several words too) and reporting words lower it, address raises it, in four languages.  A
document's score is the sum over its hits, less what clean text of its length
would score by the stems' natural rates.

Plan: one pass without a shuffle.  One edit leaves either the first or the last
half of a term as it is; tokens whose first or last bytes, first letter and
length fit no term are dropped by table lookups, and the rest go through a
per-worker memo of automaton walks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, filter_by_text, id_text
from .textkernel import Chunk, chunks

#: Term: severity.
LEXICON = {
    "idiot": 1.0, "stupid": 1.0, "moron": 1.0, "loser": 1.0, "scum": 1.0, "trash": 1.0, "clown": 1.0, "pathetic": 1.0,
    "worthless": 1.0, "disgusting": 1.0, "imbecile": 1.0, "dumbass": 1.2, "bastard": 1.2, "asshole": 1.2, "bitch": 1.2,
    "fucking": 1.2, "fucker": 1.2, "bullshit": 1.0, "dickhead": 1.2, "retard": 1.2, "wanker": 1.0,
    "scumbag": 1.2, "dimwit": 1.0, "halfwit": 1.0, "dipshit": 1.2, "jackass": 1.0, "arschloch": 1.2, "dummkopf": 1.0,
    "connard": 1.2, "abruti": 1.0, "salaud": 1.0, "gilipollas": 1.2, "pendejo": 1.0, "cabrón": 1.0, "imbécil": 1.0,
}
THRESHOLD = 0.8
#: Bound of the sample that the lexicon is fitted on: labelled rows of either class.
MAX_LABELLED = 800
WINDOW = 6
FUZZY = 0.55  # what a misspelled term counts against an exact one
REPORTING = frozenset((
    "quote quoted quotes quoting said says wrote written called word words term terms slur slurs insult insults phrase example meaning definition defined translates cites cited shouted yelled replied "
    "dit disait mot mots terme termes insulte insultes citation cité cite traité signifie définition crié sagte sagt wort wörter begriff schimpfwort beleidigung zitat zitiert genannt bedeutet rief "
    "dijo dice palabra palabras término insulto insultos cita citado llamado significa definición gritó").split())  # fmt: skip
ADDRESS = frozenset("you your you're youre yourself u ur du dich dir dein deine deiner tu toi ton vous votre usted ustedes eres".split())
QUOTES = '"“”„«»`'
#: Marks that begin a quotation, how they end it, and over how many words.
PAIRS = {'"': ('"', 40), "“": ('”"', 40), "„": ('“”"', 40), "«": ("»", 40), "»": ("«", 40), "`": ("`'", 12), "‘": ("’'", 12), "'": ("'’", 12)}
AFTER_QUOTE = ".,;:!?)]…-–"
POSSESSIVE = ("'s", "’s")
MARKS = ("!", "$")  # signs that are look-alikes too
_LEET = str.maketrans("013457@$!", "oieastasi")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    _FOLD[_a] = _b


def fold(word: str) -> str:
    return word.lower().translate(_LEET)


def allowed(term: str) -> int:
    """Edits that a variant of the term may have."""
    return 1 if len(term) >= 5 and term[-1] != "*" else 0


def _mixed(first, part, length):
    return (part * 40503 + first * 7919 + length * 104729) & ((1 << 22) - 1)


def _key(first: int, part: bytes, length: int) -> int:
    return _mixed(first, int.from_bytes(part, "big"), length)


class Lexicon:
    """A trie of terms that is walked with a token's Levenshtein automaton."""

    def __init__(self, terms: dict[str, float], rates: dict[str, float] | None = None):
        self.severity = {fold(t): s for t, s in terms.items()}
        self.natural = 3 * sum(r * terms[t] for t, r in (rates or {}).items() if t in terms)
        self.trie: dict = {}
        for t in self.severity:
            node = self.trie
            for c in t.rstrip("*"):
                node = node.setdefault(c, {})
            node["" if t[-1] != "*" else "*"] = t  # a word and a stem may end at one node
        self.memo: dict[str, tuple[str, int] | None] = {}
        self.head, self.head2, self.tail = (np.zeros(1 << 22, bool) for _ in range(3))
        self.stems: dict[int, np.ndarray] = {}
        for t in (t.encode() for t in self.severity):
            if t[-1:] == b"*":
                h = min(len(t) - 1, 5)
                self.stems.setdefault(h, np.zeros(1 << 22, bool))[_key(t[0], t[:h], 0)] = True
                continue
            n, h = len(t), len(t) // 2
            for length in range(max(3, n - 4), n + 5):  # one edit of a character of up to four bytes
                (self.head if h > 2 else self.head2)[_key(t[0], t[: min(h, 3)], length)] = True
                self.tail[_key(t[0], t[-min(n - h, 3) :] if n - h > 2 else t[-3:], length)] = True

    def walk(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits and the edits; ties go to the first in the alphabet."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << (i + 1)
        final, best = 1 << len(word), None
        stack = [(self.trie[word[0]], 2, 6)] if word[:1] in self.trie and word else []  # states reached without an edit, and with at most one
        while stack:
            node, r0, r1 = stack.pop()
            for c, nxt in node.items():
                if c == "" or c == "*":
                    e = 0 if r0 & final or r0 and nxt[-1] == "*" else 1 if r1 & final else 2
                    if e <= allowed(nxt) and (best is None or (e, nxt) < (best[1], best[0])):
                        best = (nxt, e)
                    continue
                m = masks.get(c, 0)
                s0 = (r0 << 1) & m
                s1 = ((r1 << 1) & m) | r0 | (r0 << 1) | s0 | (s0 << 1)
                s1 &= (final << 1) - 1
                if s0 or s1:
                    stack.append((nxt, s0, s1))
        return best

    def find(self, word: str) -> tuple[str, int] | None:
        if word not in self.memo:
            if len(self.memo) > 300_000:  # a cache only: forgetting costs time, never results
                self.memo.clear()
            self.memo[word] = self.walk(word)
        return self.memo[word]

    def read(self, bare: str) -> tuple[str, int] | None:
        """The nearest term of a stripped token, marks at its ends read as letters or, if that is nearer, as marks."""
        found = self.find(fold(bare)) if len(bare.encode()) >= 3 else None
        if bare[:1] in MARKS or bare[-1:] in MARKS:
            w = strip(bare, MARKS)
            other = self.find(fold(w)) if len(w.encode()) >= 3 else None
            if other and (not found or other[1] < found[1]):
                return other
        return found

    def rows_with_hits(self, chunk: Chunk) -> np.ndarray:
        """Rows of the chunk in which some token matches a term."""
        s, e = chunk.words()
        if not len(s) or not self.severity:
            return np.zeros(0, np.int64)
        d = _FOLD[chunk.data]
        d[1:][(d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E)] |= 0x20  # upper-case letters of Latin-1
        letter = ((d >= 97) & (d <= 122)) | (d >= 128)
        rows = chunk.row_of(s)
        while (open_ := np.flatnonzero((e - s > 1) & ~letter[s])).size:
            s[open_] += 1
        while (open_ := np.flatnonzero((e - s > 1) & ~letter[e - 1])).size:
            e[open_] -= 1
        raw = chunk.data
        ends = (e - s > 2) & (raw[e - 1] | 0x20 == 115)
        e = e - 2 * (ends & (raw[e - 2] == 39)) - 4 * (ends & (e - s > 4) & (raw[e - 4] == 0xE2) & (raw[e - 3] == 0x80) & (raw[e - 2] == 0x99))
        # a second reading where a mark stands at an end
        mark = (chunk.data == 33) | (chunk.data == 36)
        also = np.flatnonzero((e - s > 1) & (mark[s] | mark[e - 1]))
        s2, e2 = s[also], e[also]
        letter &= ~mark
        while (open_ := np.flatnonzero((e2 - s2 > 1) & ~letter[s2])).size:
            s2[open_] += 1
        while (open_ := np.flatnonzero((e2 - s2 > 1) & ~letter[e2 - 1])).size:
            e2[open_] -= 1
        s, e, rows = np.concatenate((s, s2)), np.concatenate((e, e2)), np.concatenate((rows, rows[also]))
        fits = np.flatnonzero(e - s >= 3)
        s, e, rows = s[fits], e[fits], rows[fits]
        w = np.concatenate((d, np.zeros(8, np.uint8))).astype(np.int64)
        first, two = w[s], w[s] << 8 | w[s + 1]
        fits = self.head2[_mixed(first, two, e - s)]
        fits |= self.head[_mixed(first, two << 8 | w[s + 2], e - s)]
        for n, table in self.stems.items():
            part = two
            for k in range(2, n):
                part = part << 8 | w[s + k]
            fits |= table[_mixed(first, part, 0)]
        fits |= self.tail[_mixed(first, w[e - 3] << 16 | w[e - 2] << 8 | w[e - 1], e - s)]
        fits = np.flatnonzero(fits)
        s, e, rows = s[fits], e[fits], rows[fits]
        _, at, back = np.unique(chunk.hashes(s, e), return_index=True, return_inverse=True)
        raw = chunk.data.tobytes()
        hit = np.fromiter((self.find(fold(raw[a:b].decode("utf-8", "replace"))) is not None for a, b in zip(s[at].tolist(), e[at].tolist())), bool, len(at))
        return np.unique(rows[hit[back]])

    def score(self, text: str) -> tuple[float, list[str]]:
        """Sum of weighed hits, and the terms hit in text order."""
        raw = text.split()
        bare = [strip(w) for w in raw]
        inside = quoted(raw)
        total, terms = -self.natural * len(raw), []
        for i, w in enumerate(bare):
            found = self.read(w)
            if not found:
                continue
            term, edits = found
            near = {x.lower() for x in bare[max(0, i - WINDOW) : i] + bare[i + 1 : i + 1 + WINDOW]}
            weight = self.severity[term] * (FUZZY if edits else 1.0)
            if inside[i] or any(q in raw[i] for q in QUOTES):
                weight *= 0.25
            elif near & REPORTING:
                weight *= 0.5
            if near & ADDRESS:
                weight *= 1.25
            total += weight
            terms.append(term)
        return round(total, 6), terms


def quoted(raw: list[str]) -> list[bool]:
    """Which tokens stand between the marks of a quotation; an apostrophe opens one only at a word's beginning."""
    out, i = [False] * len(raw), 0
    while i < len(raw):
        ends, most = PAIRS.get(raw[i].lstrip("([")[:1], ("", 0))
        for j in range(i, min(len(raw), i + most)):
            w = raw[j].rstrip(AFTER_QUOTE)
            if w[-1:] in ends and w and (j > i or len(w.lstrip("([")) > 1):
                out[i : j + 1] = [True] * (j + 1 - i)
                i = j
                break
        i += 1
    return out


def strip(word: str, marks: tuple[str, ...] = ()) -> str:
    """The token without what is no letter, look-alike (but ``marks``) or byte above ASCII at its ends, and without a possessive's ending; one character at least stays."""
    if word[:1].isalpha() and word[-1:].isalpha():
        return word[:-2] if len(word) > 2 and word[-2:].lower() in POSSESSIVE else word
    a, b, f = 0, len(word), fold(word) if word.isascii() else [fold(c)[:1] or c for c in word]
    ok = lambda c: "a" <= c <= "z" or c >= "\x80"
    while b - a > 1 and (word[a] in marks or not ok(f[a])):
        a += 1
    while b - a > 1 and (word[b - 1] in marks or not ok(f[b - 1])):
        b -= 1
    return word[a : b - 2] if b - a > 2 and word[b - 2 : b].lower() in POSSESSIVE else word[a:b]


_LEXICONS: dict[tuple, Lexicon] = {}


class Model:
    """Terms with severities, the natural rates of stems, and the score from which a document counts as toxic."""

    def __init__(self, terms: dict[str, float] = LEXICON, rates: dict[str, float] | None = None, threshold: float = THRESHOLD):
        self.terms, self.rates, self.threshold = dict(terms), dict(rates or {}), threshold

    def lexicon(self) -> Lexicon:
        key = (tuple(sorted(self.terms.items())), tuple(sorted(self.rates.items())))
        if key not in _LEXICONS:
            _LEXICONS.clear()  # a worker serves one model at a time; older ones would only hold memory
            _LEXICONS[key] = Lexicon(self.terms, self.rates)
        return _LEXICONS[key]


def learn_lexicon(docs: DataFrame, labels: DataFrame, base: dict[str, float] = LEXICON, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Add to the base lexicon the stems and words that mark toxic rows, from at most ``max_labelled`` labelled rows of either class.

    The rows are those of the smallest hashes of their ids.  A stem is a token's
    beginning of three to ten letters whose rate in toxic text is at least 20
    times that in clean text and that at least three toxic rows, and one in a hundred, have between
    neighbours that no other row has it between (so copies of one text count once),
    with a log-likelihood ratio beyond what the number of beginnings explains.  The threshold is the
    one that best parts sampled rows of either half by stems of the other half, at 0.8 or above.  Without labelled rows of
    both classes the base lexicon is returned.  Null ids, texts and labels are
    left out; an id that is labelled both ways counts as either.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").distinct()
    ids = ids.withColumn("h", F.xxhash64("doc_id"))
    picked = [tuple(r) for t in (0, 1) for r in ids.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(max_labelled).select("doc_id", "toxic").collect()]
    if len({t for _, t in picked}) < 2:
        return Model(base)
    # the few ids are a filter of the scan: no join, and no text is shuffled
    rows = id_text(docs, id_col, text_col).where(F.col("doc_id").isin(sorted({i for i, _ in picked}))).where("text <> ''").collect()
    classes: dict[int, set[int]] = {}
    for i, t in picked:
        classes.setdefault(i, set()).add(t)
    return fit(sorted({(t, r.text) for r in rows for t in classes[r.doc_id]}), base)


def fit(rows: list[tuple[int, str]], base: dict[str, float] = LEXICON) -> Model:
    """The model of ``learn_lexicon`` from (label, text) pairs."""
    rows = sorted(rows)
    scores: list[tuple[float, int]] = []
    for n in (0, 1):  # neither half is scored by what it taught
        scores += _scores(Lexicon(*_learn(rows[n::2], base)), rows[1 - n :: 2])
    terms, rates = _learn(rows, base)
    return Model(terms, rates, _threshold(sorted(scores)))


def _learn(rows: list[tuple[int, str]], base: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """Terms with severities and the stems' rates in clean text."""
    seen: list[dict[str, int]] = [{}, {}]
    words, contexts, support = [1, 1], set(), {}
    for label, text in rows:
        w, new = [strip(x) for x in text.lower().split()], set()
        words[label] += len(w)
        for before, x, after in zip(["", *w], w, [*w[1:], ""]):
            if len(x) >= 3 and (key := (label, x, before, after)) not in contexts:
                contexts.add(key)
                seen[label][x] = seen[label].get(x, 0) + 1
                new.add(x)
        if label:
            for p in {x[:k] for x in new for k in range(3, min(10, len(x)) + 1)}:
                support[p] = support.get(p, 0) + 1
    least = max(3, 0.01 * sum(label for label, _ in rows))
    counts: list[dict[str, int]] = [{}, {}]
    wanted = {p for p, n in support.items() if n >= least}
    for label in (0, 1):
        c = counts[label]
        for x, n in seen[label].items():
            for k in range(3, min(10, len(x)) + 1):
                if (p := x[:k]) in wanted:
                    c[p] = c.get(p, 0) + n
    odds = {p: (n / words[1]) / ((counts[0].get(p, 0) + 0.5) / words[0]) for p, n in counts[1].items()}
    # log-likelihood ratio against the same rate in both classes; it must outweigh the number of beginnings that are tried
    share = words[1] / sum(words)

    def sure(p: str) -> float:
        n, c = counts[1][p], counts[0].get(p, 0)
        return n * math.log(n / (n + c) / share) + (c and c * math.log(c / (n + c) / (1 - share)))

    good = {p: counts[1][p] for p, o in odds.items() if o >= 20 and sure(p) >= math.log(len(odds)) + 2}
    stems: dict[str, float] = {}
    rates: dict[str, float] = {}
    for p in sorted(good, key=lambda p: (len(p), p)):
        if any(q[-1] == "*" and p.startswith(q[:-1]) for q in stems):
            continue
        longer = p
        while best := max((q for q in good if len(q) == len(longer) + 1 and q.startswith(longer)), key=lambda q: (good[q], q), default=None):
            if good[best] < 0.95 * good[longer]:
                break
            longer = best
        stems[longer + "*"] = 1.0
        if seen[1].get(longer, 0) >= 0.9 * good[longer]:
            stems[longer] = 1.0  # a word of its own, of which misspellings count too
        rates[longer + "*"] = counts[0].get(longer, 0) / words[0]
    return stems | base, rates


def _scores(lex: Lexicon, rows: list[tuple[int, str]]) -> list[tuple[float, int]]:
    """(score, label) of each row."""
    hits: set[int] = set()
    for c in chunks(pa.array([t for _, t in rows], pa.string())):
        hits.update((c.first + lex.rows_with_hits(c)).tolist())
    return [(lex.score(t)[0] if n in hits else 0.0, label) for n, (label, t) in enumerate(rows)]


def _threshold(scores: list[tuple[float, int]]) -> float:
    n = [sum(label == k for _, label in scores) or 1 for k in (0, 1)]
    left, best = [0, 0], (-1.0, THRESHOLD)
    below = 0.0
    for k, (s, label) in enumerate(scores):
        if s > below and s >= THRESHOLD:
            at = max(THRESHOLD, below + 0.75 * (s - below))
            # a clean document that goes weighs five times a toxic one that stays
            if (gain := 5 * left[0] / n[0] + (n[1] - left[1]) / n[1]) > best[0] + 1e-9:
                best = (gain, at)
        below = max(below, s)
        left[label] += 1
    return round(best[1], 6)


def toxic_scores(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_terms, terms) of every document whose score reaches the model's threshold.

    Null, empty and wordless texts have no hit and are not listed; a row that is
    repeated is listed as often; a null doc_id is left out; an empty table gives
    an empty result.  Only the id and the text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_terms", pa.int32()), ("terms", pa.list_(pa.string()))])
    model = model or Model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = model.lexicon()
        for b in batches:
            ids, out = b.column(0), []
            for c in chunks(b.column(1)):
                for r in lex.rows_with_hits(c).tolist():
                    total, terms = lex.score(c.text(c.offsets[r], c.offsets[r + 1]))
                    if terms and total >= model.threshold:
                        out.append((ids[c.first + r].as_py(), total, len(terms), terms))
            if out:
                yield batch(schema, list(zip(*out)))

    return id_text(docs, id_col, text_col).where("doc_id is not null").mapInArrow(run, "doc_id long, score double, n_terms int, terms array<string>")


def drop_toxic(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns; null texts and null ids stay."""
    model = model or Model()

    def keep(texts: pa.Array) -> pa.Array:
        lex, ok = model.lexicon(), np.ones(len(texts), bool)
        for c in chunks(texts):
            for r in lex.rows_with_hits(c).tolist():
                total, terms = lex.score(c.text(c.offsets[r], c.offsets[r + 1]))
                ok[c.first + r] = not terms or total < model.threshold
        return pa.array(ok)

    return filter_by_text(docs, keep, text_col)
