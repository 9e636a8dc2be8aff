import random
import re

import pyarrow as pa

from swimlane.llm import line_dedup as L
from swimlane.llm.queries import op2_line_dedup
from swimlane.llm.textkernel import chunks


def lines_of(text):
    """Lines as tuples of tokens, by the plain definition."""
    out = []
    for line in re.split("\n", text):
        part = []
        for w in re.findall(r"[^\x00-\x20]+", line):
            part.append(re.sub("[A-Z]", lambda m: m[0].lower(), w))
            if w[-1] in ".!?":
                out.append(tuple(part))
                part = []
        if part:
            out.append(tuple(part))
    return out


def test_lines_are_the_plain_definition(docs):
    texts = [r.text for r in docs.limit(80).collect()]
    seen = {}
    for c in chunks(pa.array(texts)):
        x = L.Lines(c, 20, 20)
        for r in range(c.rows):
            plain = lines_of(texts[c.first + r])
            mine = x.hash[x.row == r].tolist()
            assert len(plain) == len(mine) and [len(p) for p in plain] == x.words[x.row == r].tolist()
            for p, h in zip(plain, mine):
                assert seen.setdefault(p, h) == h
    assert len(set(seen.values())) == len(seen)


def runs_before(order, least):
    """Hash-free: for each document its lines in a run of ``least`` words that stands in an earlier document or, earlier, in itself; every earlier place is tried and every match extended as far as it goes."""
    seen, texts, repeated = {}, dict(order), {}
    for i, lines in order:
        n, hit, own, grams = len(lines), set(), {}, []
        for a in range(n):
            k, b = 0, a
            while b < n and k < least:
                k += len(lines[b])
                b += 1
            if k >= least:
                grams.append((a, b, tuple(lines[a:b])))
        for a, b, g in grams:
            for j, c in seen.get(g, ()):
                other, low, high = texts[j], 0, 0
                while low < min(a, c) and lines[a - 1 - low] == other[c - 1 - low]:
                    low += 1
                while b + high < n and c + b - a + high < len(other) and lines[b + high] == other[c + b - a + high]:
                    high += 1
                hit.update(range(a - low, b + high))
            if g in own and own[g] <= a:
                hit.update(range(a, b))
            own.setdefault(g, b)
        for a, _, g in grams:
            seen.setdefault(g, []).append((i, a))
        repeated[i] = hit
    return repeated


def is_subsequence(small, large):
    it = iter(large)
    return all(x in it for x in small)


def check(rows, got):
    """Only lines of runs that are repeated go; of every repeated passage long enough some lines go."""
    order = sorted((i, lines_of(t)) for i, t in rows)
    sound = runs_before(order, L.NOISE_WORDS)
    for i, lines in order:
        left = lines_of(got.get(i, ""))
        must = [ln for n, ln in enumerate(lines) if n not in sound[i]]
        assert is_subsequence(left, lines), i
        assert is_subsequence(must, left), i
        # guarantee: no window of noise + window words that an earlier text has is left whole
    seen = set()
    for i, lines in order:
        left = lines_of(got.get(i, ""))
        for a in range(len(left)):
            k, b = 0, a
            while b < len(left) and k < L.NOISE_WORDS + L.WINDOW_WORDS:
                k += len(left[b])
                b += 1
            if k >= L.NOISE_WORDS + L.WINDOW_WORDS:
                assert tuple(left[a:b]) not in seen or b - a > 60, (i, left[a:b])
        for a in range(len(lines)):
            k, b = 0, a
            while b < len(lines) and k < L.NOISE_WORDS + L.WINDOW_WORDS:
                k += len(lines[b])
                b += 1
            if k >= L.NOISE_WORDS + L.WINDOW_WORDS:
                seen.add(tuple(lines[a:b]))


def test_query_against_brute_force(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in op2_line_dedup(spark, sf).collect()}
    assert sum(len(t) for t in got.values()) < sum(len(t) for _, t in rows)
    check(rows, got)


def test_passages_go_from_later_documents(make):
    r = random.Random(1)
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(n))
    passage = ". ".join(say(11).capitalize() for _ in range(5)) + "."
    rows = [(n, f"{say(30)}.\n{passage}\n{say(25)}.") for n in range(20)] + [(50, f"{say(30)}. {passage} {say(8)}.")]
    got = {x.doc_id: x.text for x in L.dedup_lines(make(rows)).collect()}
    assert got[0] == rows[0][1]
    for i, t in rows[1:]:
        assert passage not in got[i] and t.split(".")[0] in got[i] and t.rstrip(".").split()[-1] in got[i]
    check(rows, got)


def test_exact_copies_go(make):
    text = "This line has a good many words in it so that it is a gram by itself for sure, and then some more."
    got = [x.doc_id for x in L.dedup_lines(make([(5, text), (9, text), (7, text)])).collect()]
    assert got == [5]
    kept = {x.doc_id: (x.text, x.n_chars) for x in L.dedup_lines(make([(5, text), (9, text)]), drop_emptied=False).collect()}
    assert kept == {5: (text, len(text)), 9: ("", 0)}


def test_repeats_within_a_text(make):
    run = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    x = L.dedup_lines(make([(1, f"{run}\nBetween the two.\n{run}\nThe end.")])).first()
    assert lines_of(x.text) == lines_of(f"{run}\nBetween the two.\nThe end.")


def test_edges(make, edge_rows):
    df = make(edge_rows)
    got = L.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert L.dedup_lines(make([])).count() == 0


def test_same_id_is_one_document(make):
    t = "This line has a good many words in it so that it is a gram by itself for sure, and then some more."
    assert L.dedup_lines(make([(1, t), (1, t)])).count() == 2
