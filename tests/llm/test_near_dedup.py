import random
import re

import numpy as np
import pyarrow as pa
import pytest

from swimlane.llm import near_dedup as N
from swimlane.llm.queries import op6_simhash
from swimlane.llm.textkernel import chunks


def signatures(rows):
    out = {}
    for c in chunks(pa.array([t for _, t in rows])):
        at, s = N.simhash(c)
        for r, x in zip(at.tolist(), s):
            out[rows[c.first + r][0]] = int(x[0]) | int(x[1]) << 64
    return out


def groups(sig, most):
    ids = sorted(sig)
    par = {i: i for i in ids}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (sig[a] ^ sig[b]).bit_count() <= most:
                x, y = sorted((root(a), root(b)))
                par[y] = x
    return {(i, root(i)) for i in ids if root(i) != i}


def test_query_equals_brute_force(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.doc_id, r.kept_id) for r in op6_simhash(spark, sf).collect()}
    assert got == groups(signatures(rows), 2 * N.SEGMENTS - 1) and got


def test_signature_is_the_majority_of_distinct_tokens():
    text = "The cat the CAT sat on on on a mat " + " ".join(f"w{i}" for i in range(700))
    c = next(chunks(pa.array(["", text])))
    rows, token = N.distinct_tokens(c)
    assert len(token) == len({re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in text.split()}) and set(rows.tolist()) == {1}
    h = np.stack((N.mix(token * N._U(0x2545F4914F6CDD1D) + N._U(1)), N.mix(token * N._U(0x9E6C63D0876A9A47) + N._U(7))), axis=1)
    want = [sum(int(x) >> b & 1 for x in h[:, w]) * 2 > len(token) for w in (0, 1) for b in range(64)]
    _, s = N.simhash(c)
    assert [bool(int(s[0, w]) >> b & 1) for w in (0, 1) for b in range(64)] == want


@pytest.mark.parametrize("segments", [4, 6, 7, 8])
def test_every_pair_within_the_distance_meets(segments):
    r, most = random.Random(segments), 2 * segments - 1
    for _ in range(300):
        a = r.getrandbits(128)
        b = a
        for bit in r.sample(range(128), most):
            b ^= 1 << bit
        s = np.array([[x & (2**64 - 1), x >> 64] for x in (a, b)], np.uint64)
        k = N.variants(s, segments)
        assert k.shape == (2, 128) and set(k[0].tolist()) & set(k[1].tolist())


def test_forest_connects_as_all_pairs():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, (5, 2), dtype=np.uint64)
    s = base[r.integers(0, 5, 400)]
    for n in range(400):
        for b in r.integers(0, 64, 4):
            s[n, n % 2] ^= np.uint64(1) << np.uint64(b)
    s = np.unique(s, axis=0)
    key = np.zeros(len(s), np.int64)

    def joined(pairs):
        return groups_of(len(s), zip(*(x.tolist() for x in pairs)))

    all_pairs = [(i, j) for i in range(len(s)) for j in range(i) if N.apart(s[i], s[j]) <= 13]
    assert joined(N.forest(s, 13)) == groups_of(len(s), all_pairs) == joined(N.key_pairs(key, s, small=10))


def test_each_pair_comes_once():
    r = np.random.default_rng(3)
    s = np.repeat(r.integers(0, 2**63, (40, 2), dtype=np.uint64), 3, axis=0)
    for n in range(len(s)):
        for b in r.integers(0, 128, 5):
            s[n, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    s = np.unique(s, axis=0)
    k = N.variants(s)
    at = np.repeat(np.arange(len(s)), 128)
    order = np.argsort(k.reshape(-1), kind="stable")
    a, b = N.key_pairs(k.reshape(-1)[order].view(np.int64), s[at[order]])
    got = [tuple(sorted((int(at[order[i]]), int(at[order[j]])))) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for j in range(len(s)) for i in range(j) if N.apart(s[i], s[j]) <= 13}


def groups_of(n, pairs):
    par = list(range(n))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        par[y] = x
    return [root(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    pairs = [(n, n + 1) for n in range(60)] + [(100, k) for k in range(101, 160)] + [(300, 200), (200, 300), (5, 5)]
    got = {(r.node, r.root) for r in N.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {(n, 0) for n in range(61)} | {(k, 100) for k in range(100, 160)} | {(200, 200), (300, 200)}
    assert N.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_copies_go_and_one_stays(make):
    r = random.Random(4)
    say = lambda n: [("".join(r.choices("abcdefghij", k=r.randint(2, 9)))) for _ in range(n)]
    rows = []
    for g in range(8):
        base = say(150)
        for k in range(2 + 6 * (g == 0)):
            w = list(base)
            if k:
                w[r.randrange(150)] += "xyz"
                del w[r.randrange(149)]
            rows.append((100 * g + k, " ".join(w)))
    rows += [(900, rows[0][1]), (901, " ".join(say(150)))]
    kept = sorted(x.doc_id for x in N.drop_near_duplicates(make(rows)).collect())
    assert kept == [100 * g for g in range(8)] + [901]


def test_edges(make, edge_rows):
    df = make(edge_rows)
    assert {(r.doc_id, r.kept_id) for r in N.near_duplicates(df).collect()} == {(6, 5)}
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    # one of the equal texts and of the repeated rows; what has no id or no token stays
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "1", "2", "3", "4", "5", "7", "8", "9", "-3"])
    assert N.near_duplicates(make([])).count() == 0 and N.drop_near_duplicates(make([])).count() == 0


def test_pairs_of_near_copies_are_found(make):
    """Two documents of word-3-gram Jaccard 0.7 or more, with no other copy that could connect them."""
    r = random.Random(11)
    say = lambda n: ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(n)]
    rows = []
    for g in range(150):
        a = say(200)
        b = list(a)
        for i in range(0, 200, 19):
            b[i] = say(1)[0]
        grams = [{tuple(w[i : i + 3]) for i in range(198)} for w in (a, b)]
        assert 0.7 <= len(grams[0] & grams[1]) / len(grams[0] | grams[1]) < 0.75
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
    got = {(x.doc_id, x.kept_id) for x in N.near_duplicates(make(rows)).collect()}
    assert got <= {(2 * g + 1, 2 * g) for g in range(150)} and len(got) >= 0.95 * 150


def test_close_pairs_are_all_pairs():
    r = np.random.default_rng(5)
    s = np.repeat(r.integers(0, 2**63, (300, 2), dtype=np.uint64), 3, axis=0)
    for n in range(len(s)):
        for b in r.integers(0, 128, 12):
            s[n, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    a, b = N.close_pairs(s, 21, tile=100)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for j in range(len(s)) for i in range(j) if N.apart(s[i], s[j]) <= 21}
    assert N.close_pairs(np.zeros((40, 2), np.uint64), 21) is None


def test_an_id_with_two_texts_loses_only_the_copy(make):
    r = random.Random(21)
    say = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(n))
    a, b, c = say(150), say(150), say(150)
    df = make([(1, a), (2, a), (2, b), (3, c), (2, b), (4, b + " more")])
    assert {(x.doc_id, x.kept_id) for x in N.near_duplicates(df).collect()} == {(2, 1), (4, 2)}
    assert sorted((x.doc_id, x.text) for x in N.drop_near_duplicates(df).collect()) == sorted([(1, a), (2, b), (3, c)])


def test_of_repeated_rows_the_same_one_stays(spark):
    rows = [(1, "some text of a few words here", k) for k in range(40)]
    kept = {N.drop_near_duplicates(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, note int").repartition(3)).collect()[0].note for k in (0, 7, 23)}
    assert len(kept) == 1
