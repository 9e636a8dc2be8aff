"""Personal data by candidate gradient boosting.

Method: high-recall generators, one per kind, propose spans, overlapping and far
too many (of a run of digit groups every part that begins and ends with a group); boosted trees score each from its format (length, groups, check sums,
separators, value ranges) and its context (cue words, what touches it); each
kind's threshold is calibrated for precision on held-out rows; of overlapping
spans above their thresholds the surest is redacted.

The trees are trained here, on spans written and broken by rule (``training_rows``),
so the model needs no personal data.

Plan: one pass without a shuffle; every generator needs a digit, an at sign or a group between colons,
so texts with none of them are dropped before Python sees them.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, id_text

KINDS = ("email", "phone", "card", "ip", "ssn", "iban")
#: Recall first: each takes in much that is not personal.  Bounds are those of the formats: a telephone number has 7 to 15
#: digits in at most seven groups (more than five signs between two of them part numbers), a card's 12 to 19 digits, an IBAN up to 34 characters.
GENERATORS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++"),
    "phone": re.compile(r"(?<![\w.])(?:\+|\(|00)?\d+(?:[().\-/ ]{1,5}\d+){0,6}(?!\w)"),
    "card": re.compile(r"(?<!\w)\d(?:[ -]?\d){11,18}(?!\w)"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])|(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){1,6}(?::[0-9A-Fa-f]{1,4}|(?<=:):)(?!\w|:[\w:])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}(?!\w)"),
}
#: Where a part of a run of groups may begin, and the groups after which it may end.
PARTS = {
    "phone": (re.compile(r"(?<![\w.])(?=(?:\+|\(|00)?\d)"), re.compile(r"(?:\+|\(|00)?\d+(?:[().\-/ ]{1,5}\d+){0,6}(?!\w)"), re.compile(r"\d(?=[().\-/ ])")),
    "card": (re.compile(r"(?<!\w)(?=\d)"), re.compile(r"\d(?:[ -]?\d){11,18}(?!\w)"), re.compile(r"\d(?=[ -])")),
    "iban": (re.compile(r"(?<!\w)(?=[A-Z]{2}\d{2})"), re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}(?!\w)"), re.compile(r"\w(?= )")),
}
CUES = {
    "email": "email mail e-mail contact write reach",
    "phone": "phone tel telephone call mobile cell fax contact whatsapp tél telefon",
    "card": "card visa mastercard amex credit debit payment pay cc",
    "ip": "ip address host server from login client addr",
    "ssn": "ssn social security",
    "iban": "iban account bank konto transfer",
}
ANTI = frozenset("version v order invoice isbn issn page pages section chapter figure table no number id item sku part line build release ratio score year date serial ticket commit hash eq equation vol volume".split())
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
_WORD = re.compile(r"[\w-]+")
#: What joins a span to digits beside it.
_JOINED = (re.compile(r"[\d+(]([().\-/ ]{0,2})$"), re.compile(r"([().\-/ ]{0,2})\d"))


def luhn(digits: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        s += d - 9 * (d > 9)
    return s % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def issued(kind: str, digits: str) -> bool:
    """Whether such a number is given out: a social security number by its parts, a card by its issuer's prefix and length."""
    if kind == "ssn":
        area, group, serial = digits[:3], digits[3:5], digits[5:]
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    if kind != "card" or not digits.isascii():
        return False
    four = int(digits[:4])
    sizes = (16, 19, 13) if digits[0] == "4" else (16,) if 5100 <= four < 5600 or 2221 <= four < 2721 or four == 6011 or 6440 <= four < 6600 or 3528 <= four < 3590 else (15,) if digits[:2] in ("34", "37") else (14,) if digits[:2] in ("36", "38") else ()
    return len(digits) in sizes


def ipv6(span: str) -> bool:
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all generators; spans may overlap, those of one kind too."""
    out = []
    for kind, g in GENERATORS.items():
        if kind not in PARTS:
            out += [(m.start(), m.end(), kind) for m in g.finditer(text)]
            continue
        begin, longest, cut = PARTS[kind]
        for m in begin.finditer(text):
            if not (m := longest.match(text, a := m.start())):
                continue
            ends = [c.end() for c in cut.finditer(text, a, m.end()) if g.fullmatch(text, a, c.end())]
            for z in (m.end(), *ends):
                if kind != "phone" or 7 <= sum(map(str.isdigit, text[a:z])) <= 15:
                    out.append((a, z, kind))
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a span, as numbers."""
    span = text[start:end]
    digits = re.sub(r"\D", "", span)
    groups = re.findall(r"\d+", span)
    before, after = text[max(0, start - 48) : start], text[end : end + 32]
    near = [w.lower() for w in _WORD.findall(before)[-4:]] + [w.lower() for w in _WORD.findall(after)[:2]]
    host = span.partition("@")[2]
    tld = host.rpartition(".")[2]
    octets = [int(g) for g in groups] if kind == "ip" and "." in span else []
    return [
        KINDS.index(kind), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.startswith(("+", "00")), "(" in span and ")" in span, sum(not c.isalnum() for c in span), len(set(re.sub(r"[\w]", "", span))),
        bool(digits) and luhn(digits), kind == "iban" and mod97(span), bool(octets) and all(o <= 255 for o in octets) and octets[0] > 0,
        len(tld) if kind == "email" and tld.isalpha() else 0, host.count("."), any(w in _CUES[kind] for w in near), sum(w in ANTI for w in near),
        kind == "ip" and ":" in span and ipv6(span), before[-1:] in ("/", "=", "#", "$", "€", "_", "-", "."), after[:1] in ("%", "/", "_", "-", "$", "€", "="), len(set(digits)) if digits else 0,
        issued(kind, digits), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, *(0 if not j else 3 if j[1] != " " else 1 + (" " in span) for j in (_JOINED[0].search(before[-3:]), _JOINED[1].match(after))),
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(self.cuts, x.T)], axis=1)
        p = y.mean()
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree: list[list[float]] = []  # feature, bin, left, right, value
            self._grow(tree, b, y - q, q * (1 - q), np.arange(len(y)), 0)
            self.trees.append(np.array(tree))
            f += self._tree(self.trees[-1], b)
        return self

    def _grow(self, tree: list, b: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, level: int) -> int:
        me = len(tree)
        gs, hs = g[at].sum(), h[at].sum()
        tree.append([-1, 0, -1, -1, self.rate * gs / (hs + 1)])
        best = (1e-6, -1, 0)
        if level < self.depth and len(at) >= 2 * self.least:
            for j in range(b.shape[1]):
                n = len(self.cuts[j]) + 1
                if n < 2:
                    continue
                cg, ch, cn = (np.cumsum(np.bincount(b[at, j], w, n))[:-1] for w in (g[at], h[at], np.ones(len(at))))
                gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
                gain[(cn < self.least) | (len(at) - cn < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] >= 0:
            left = b[at, best[1]] <= best[2]
            a = self._grow(tree, b, g, h, at[left], level + 1)
            z = self._grow(tree, b, g, h, at[~left], level + 1)
            tree[me][:4] = [best[1], best[2], a, z]
        return me

    @staticmethod
    def _tree(tree: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), np.int64)
        while (inner := tree[at, 0] >= 0).any():
            i = np.flatnonzero(inner)
            node = tree[at[i]]
            left = b[i, node[:, 0].astype(int)] <= node[:, 1]
            at[i] = np.where(left, node[:, 2], node[:, 3]).astype(int)
        return tree[at, 4]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(self.cuts, x.T)], axis=1)
        f = np.full(len(x), self.start)
        for t in self.trees:
            f += self._tree(t, b)
        return 1 / (1 + np.exp(-f))


def _invented(r: random.Random, kind: str, real: bool) -> str:
    d = lambda n: "".join(r.choices("0123456789", k=n))
    w = lambda a, b: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(a, b)))
    if kind == "email":
        user = r.choice([w(2, 9), f"{w(2, 7)}.{w(2, 8)}", f"{w(2, 7)}{d(2)}", f"{w(3, 8)}_{w(2, 6)}", f"{w(3, 8)}.{d(2)}"])
        host = r.choice([f"{w(3, 9)}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'edu'])}", f"{w(3, 8)}{d(1)}.{w(4, 9)}.com", f"{w(2, 6)}.{w(3, 8)}.co.uk"])
        return f"{user}@{host}" if real else r.choice([f"{w(2, 8)}@{w(1, 9)}", f"{user}@{d(3)}", f"{w(1, 6)}@{w(2, 6)}.{d(2)}", f"{user}@{w(2, 5)}."])
    if kind == "phone":
        if real:
            return r.choice([f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+{r.randint(30, 49)} {d(2)} {d(3)} {d(2)} {d(2)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}"])
        return r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}", d(r.randint(7, 18)), f"{d(2)} {d(2)} {d(3)}", f"{r.randint(1900, 2030)} - {r.randint(1900, 2030)}", f"{d(3)}.{d(5)}", f"{d(1)}.{d(1)}.{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(2)}.{d(2)}.{d(3)}.{d(2)}", f"{d(5)}-{d(5)}", f"{d(1)} 000 {d(3)}"])
    if kind == "card":
        body = r.choice(["4", "5" + r.choice("12345"), "4", "34", "6011"])
        n = 15 if body == "34" else 16
        body += d(n - 1 - len(body))
        check = next(c for c in "0123456789" if luhn(body + c))
        s = body + check
        if real:
            # like the numbers of shops' test data: most obey the check digit, some only the issuer's prefix
            s = s if r.random() < 0.6 else body + d(1)
        else:
            n = r.choice([12, 13, 14, 17, 18, 19, 16])
            s = r.choice("012789") + d(n - 1)
        return s if r.random() < 0.6 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    if kind == "ip":
        o = lambda top: ".".join(str(r.randint(0, top)) for _ in range(4))
        if real and r.random() < 0.4:
            groups = [r.choice(["2001", "2a02", "2600", "fe80", "fd00"]), *(f"{r.getrandbits(r.choice([4, 12, 16, 16])):x}" for _ in range(7))]
            zero = r.randint(1, 5)
            return r.choice([":".join(groups), ":".join(g.zfill(4) for g in groups), ":".join(groups[:zero]) + "::" + ":".join(groups[zero + r.randint(2, 6 - min(zero, 4)) :][:6] or groups[-1:])])
        if not real and r.random() < 0.4:
            return r.choice([":".join(f"{r.getrandbits(8):02x}" for _ in range(6)), f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}:{d(3)}", ":".join(d(r.randint(1, 3)) for _ in range(r.randint(3, 7)))])
        return f"{r.randint(1, 223)}.{o(255).split('.', 1)[1]}" if real else r.choice([o(999), f"{r.randint(256, 999)}.{o(255).split('.', 1)[1]}", f"0.{d(1)}.{d(1)}.{d(1)}", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}"])
    if kind == "ssn":
        return f"{r.randint(1, 665):03}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}" if real else f"{r.choice([0, 666, 900 + r.randint(0, 99)]):03}{r.choice(' -')}{r.choice([0, r.randint(0, 99)]):02} {d(4)}"
    body = r.choice(["DE", "FR", "ES", "GB", "NL"])
    rest = d(r.choice([16, 18, 20]))
    for k in range(98):
        if mod97(s := f"{body}{k:02}{rest}"):
            break
    s = s if real else f"{body}{r.randint(0, 99):02}{r.choice([rest, w(8, 12).upper() + d(4)])}"
    return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def training_rows(n: int = 800, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of n true and n false spans a kind, in invented text; true ones stand in plain text or after a cue, false ones in plain text or after a counter-cue;
    some have another number beside them.  Other spans that the generators propose over one are false."""
    r = random.Random(seed)
    filler = ["".join(r.choices(["th", "re", "on", "en", "au", "ie", "la", "do", "que"], k=r.randint(1, 4))) for _ in range(400)]
    x, y = [], []
    for kind in KINDS:
        for real in (True, False):
            for _ in range(n):
                words = r.choices(filler, k=6)
                if r.random() < 0.35:
                    words[-1] = r.choice(CUES[kind].split()) if real else r.choice(sorted(ANTI))
                span, lead = _invented(r, kind, real), " ".join(words) + " "
                if kind == "ip" and words[-1] in ANTI and r.random() < 0.5:  # a version
                    span = ".".join(str(r.randint(0, 20)) for _ in range(4))
                if not real and r.random() < 0.15:
                    lead = lead[:-1] + r.choice(["/", "=", "#", "$", "_"])
                beside = r.choice([_invented(r, r.choice(("phone", "card", "ip", "ssn")), True), _invented(r, kind, True), str(r.randint(0, 999))])
                side = r.random()
                if side < 0.15:
                    lead += beside + " "
                tail = " " + beside if 0.15 < side < 0.3 else ""
                text = lead + span + tail + r.choice([" ", ". ", ", ", "\n"]) + " ".join(r.choices(filler, k=3))
                a, z = len(lead), len(lead) + len(span)
                x.append(features(text, a, z, kind))
                y.append(real)
                parts = [c for c in candidates(text) if c[0] < z and c[1] > a and c[:2] != (a, z)]
                for c in r.sample(parts, min(1, len(parts))):
                    x.append(features(text, *c))
                    y.append(False)
    return np.array(x, float), np.array(y, float)


class Model:
    """Trees and, by kind, the lowest score that keeps the wanted precision on held-out rows."""

    def __init__(self, precision: float = 0.97):
        x, y = training_rows()
        held = np.random.default_rng(11).random(len(y)) < 0.25
        self.trees = Trees().fit(x[~held], y[~held])
        p = self.trees.predict(x[held])
        self.thresholds = {}
        for k, kind in enumerate(KINDS):
            of = x[held][:, 0] == k
            order = np.argsort(-p[of])
            good = np.cumsum(y[held][of][order]) / np.arange(1, of.sum() + 1)
            best = np.flatnonzero(good >= precision)
            self.thresholds[kind] = float(max(0.5, p[of][order][best[-1]])) if len(best) else 1.0

    def redactions(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) that are chosen, none overlapping another, in text order."""
        found = candidates(text)
        if not found:
            return []
        p = self.trees.predict(np.array([features(text, *c) for c in found], float))
        return choose([(a, b, k, float(s)) for (a, b, k), s in zip(found, p) if s >= self.thresholds[k]])


def choose(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping spans the surest, then the longest, then the first by place and kind."""
    out: list[tuple[int, int, str, float]] = []
    from bisect import bisect_left

    starts: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0], KINDS.index(s[2]))):
        i = bisect_left(starts, (s[0], s[0]))
        if (i == 0 or starts[i - 1][1] <= s[0]) and (i == len(starts) or starts[i][0] >= s[1]):
            starts.insert(i, (s[0], s[1]))
            out.append(s)
    return sorted(out)


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, score, value): the spans to redact, in characters of the text.

    Spans of one text do not overlap.  Null and empty texts have none; a null id is left
    out; repeated rows are reported each; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64()), ("value", pa.string())])
    trained = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = trained.value
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            spans = [(r, c) for r, (_, t) in enumerate(rows) for c in candidates(t)]
            if not spans:
                continue
            p = m.trees.predict(np.array([features(rows[r][1], *c) for r, c in spans], float))
            by: dict[int, list] = {}
            for (r, (a, z, k)), s in zip(spans, p.tolist()):
                if s >= m.thresholds[k]:
                    by.setdefault(r, []).append((a, z, k, s))
            out = [(rows[r][0], a, z, k, round(s, 6), rows[r][1][a:z]) for r, found in by.items() for a, z, k, s in choose(found)]
            if out:
                yield batch(schema, list(zip(*out)))

    has = id_text(docs, id_col, text_col).where("doc_id is not null").where(F.col("text").rlike(r"[\p{Nd}@]|[A-Fa-f]:[A-Fa-f]*:"))
    return has.mapInArrow(run, "doc_id long, start int, end int, kind string, score double, value string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, kind, *_ in sorted(spans):
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])
