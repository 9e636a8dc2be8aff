import random

import pytest

from swimlane.llm import decontamination as D
from swimlane.llm.queries import op1_decontamination


def levenshtein_in(pattern, text):
    """Smallest edit distance of the pattern to any part of the text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def brute(docs, items):
    out = set()
    for i, t in docs:
        n = D.normalise(t or "")
        for k, q in items:
            p = D.normalise(q)
            if len(p) >= D.MIN_CHARS:
                d, _ = D.myers(p, n)
                if n and d <= int(D.MAX_ERROR_RATE * len(p)):
                    out.add((i, k, d))
    return out


def test_myers_is_the_plain_table():
    r = random.Random(5)
    for _ in range(200):
        p, t = ("".join(r.choices("ab c", k=r.randint(1, n))) for n in (12, 40))
        assert D.myers(p, t)[0] == levenshtein_in(p, t)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id, r.distance) for r in op1_decontamination(spark, sf).collect()}
    assert got == brute(docs, items) and got


def test_edited_copies_and_shards(spark, make):
    r = random.Random(3)
    items = [(k, " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(25))) for k in range(6)]
    rows = []
    for n in range(40):
        k, t = items[n % 6]
        t = list(t.upper() if n % 2 else t.replace(" ", "\n "))
        for _ in range(n % 12):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice([[], ["x"], [t[at], "q"]])
        rows.append((n, "before " + "".join(t) + " after"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.distance) for x in D.contaminated(make(rows), b).collect()}
    assert got == brute(rows, items) and len(got) > 15
    parts = {(x.doc_id, x.item_id, x.distance) for x in D.contaminated(make(rows), b, shard_bytes=200).collect()}
    assert parts == got
    left = {x.doc_id for x in D.drop_contaminated(make(rows), b, shard_bytes=200).collect()}
    assert left == {i for i, _ in rows} - {i for i, _, _ in got}


def test_edges(spark, make, edge_rows):
    b = spark.createDataFrame([(1, None), (None, "a null id with some words here"), (2, ""), (3, "short"), (4, "same text twice here and more"), (5, edge_rows[9][1][1000:1200]), (5, edge_rows[9][1][1000:1200])], "item_id long, text string")
    got = [(x.doc_id, x.item_id, x.distance) for x in D.contaminated(make(edge_rows), b).collect()]
    assert got == [(8, 5, 0)]
    kept = D.drop_contaminated(make(edge_rows), b)
    assert kept.count() == len(edge_rows) - 1 and kept.columns == make([]).columns
    assert D.contaminated(make([]), b).count() == 0 and D.contaminated(make(edge_rows), b.limit(0)).count() == 0


def test_place(spark, make):
    b = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again")], "item_id long, text string")
    x = D.contaminated(make([(1, "so:  the QUICK brown\nfox jumps over the lazy dog again!")]), b).first()
    assert D.normalise("so:  the QUICK brown\nfox jumps over the lazy dog again!")[x.match_start : x.match_end] == "the quick brown fox jumps over the lazy dog again"


@pytest.mark.parametrize("n", [24, 60, 131])
def test_pieces_are_one_more_than_the_budget(n):
    m = D.Matcher([(1, "abcdefghijklmnopqrstuvwxyz0123456789" * 4)[:1] + (("abcdefghijklmnopqrstuvwxyz0123456789" * 4)[:n],)], 0.06, 24)
    assert m.budget == [int(0.06 * n)]


def test_short_items_are_found_as_whole_words(spark, make):
    b = spark.createDataFrame([(1, "Why so few?"), (2, "ox"), (3, "12 characters"), (4, "短い質問ですか"), (5, "a sentence of 30 characters ok")], "item_id long, text string")
    rows = [(1, "they asked: why  SO few? and left"), (2, "an ox and a fox"), (3, "a fox, two boxes"), (4, "these12 characters no"), (5, "(12\ncharacters)"), (6, "前文。短い質問ですかと聞いた"), (7, "ox"), (8, "a sentance of 30 characters ok"), (9, "why so few"), (10, "a fox met an ox")]
    got = {(x.doc_id, x.item_id, x.distance) for x in D.contaminated(make(rows), b).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (5, 3, 0), (6, 4, 0), (7, 2, 0), (8, 5, 1), (10, 2, 0)}
    assert {x.doc_id for x in D.drop_contaminated(make(rows), b).collect()} == {3, 4, 9}
    x = next(x for x in D.contaminated(make(rows), b).collect() if x.doc_id == 10)
    assert (x.match_start, x.match_end) == (13, 15)


def test_places_beyond_ascii_and_step_ends():
    r = random.Random(8)
    say = lambda n: "".join(r.choices("abc déñ中ß 🙂", k=n)).strip() or "x"
    items = [(n, say(r.randint(1, 60))) for n in range(40)]
    m = D.Matcher(items, 0.1)
    texts = [say(40) + " " + q + " " + say(40) for _, q in items] + [say(200)]
    small = D.Matcher(items, 0.1)
    plain = small.pieces.hits
    small.pieces.hits = lambda data: plain(data, step=7)
    got = list(m.many(texts))
    assert got == list(small.many(texts, most=90)) and {n for n, i, *_ in got if n == i} >= set(range(40))
    for n, i, d, a, z in got:
        t = D.normalise(texts[n])
        pattern = D.normalise(dict(items)[i])
        assert levenshtein_in(pattern, t) == d == levenshtein_in(pattern, t[a:z])
