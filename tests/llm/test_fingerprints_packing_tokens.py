import random
from collections import Counter, defaultdict

import pyarrow as pa

from swimlane.llm import order_minhash as O, packing as P, token_counts as K
from swimlane.llm.queries import op4_order_minhash, op5_packing, op7_token_counts
from swimlane.llm.textkernel import chunks


def sketch_of(text, k=O.K, m=O.M, l=O.L):  # noqa: E741
    """One text's signature by the plain definition, on the same hashes."""
    c = next(chunks(pa.array([text])))
    s, e = c.words()
    h = [int(x) for x in c.hashes(s, e)]
    one = lambda x: int(O.mix(O.np.array([x & (2**64 - 1)], O._U))[0])
    grams = [h[i : i + k] for i in range(max(1, len(h) - k + 1))] if h else []
    value = []
    for g in grams:
        v = 0
        for x in g:
            v = one(v * 0xA0761D6478BD642F + x)
        value.append(v)
    seen, numbered = Counter(), []
    for v in value:
        numbered.append(one(v + one(seen[v])))
        seen[v] += 1
    out = []
    for j in range(m if value else 0):
        order = sorted(range(len(value)), key=lambda i: one(numbered[i] ^ one(j + 1)))[:l]
        t = 0
        for i in sorted(order):
            t = one(t * 0xE7037ED1A0B428DB + value[i])
        out.append(t - 2**64 if t >= 2**63 else t)
    return out


def test_signatures_equal_brute_force(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: list(r.signature) for r in op4_order_minhash(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts, key=lambda i: len(texts[i]))[:60]:
        assert got[i] == sketch_of(texts[i]), i


def test_signatures_follow_edits_and_order():
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(300)]
    share = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
    base = sketch_of(" ".join(words), m=64)
    few = words[:]
    for n in range(0, 300, 60):
        few[n] = "new"
    turned = words[150:] + words[:150]
    assert share(base, base) == 1 and share(base, sketch_of(" ".join(few), m=64)) > 0.75
    # the same k-mers in another order: MinHash would see no difference
    assert share(base, sketch_of(" ".join(turned), m=64)) < 0.75
    assert share(base, sketch_of(" ".join(reversed(words)), m=64)) < 0.1


def test_signature_edges(make, edge_rows):
    got = O.fingerprints(make(edge_rows)).collect()
    assert len(got) == len(edge_rows) - 1
    by = {r.doc_id: r for r in got}
    assert by[1].signature == [] and by[2].n_kmers == 0 and by[3].signature == []
    assert by[4].n_kmers == 1 and len(by[4].signature) == O.M and by[5].signature == by[6].signature
    assert by[4].signature == sketch_of("one") and by[8].n_kmers == 79_999
    assert O.fingerprints(make([])).count() == 0


def check_packs(rows, docs, capacity):
    tokens = {i: len((t or "").split()) for i, t in docs}
    places, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.doc_id, r.copy].append((r.start, r.n_tokens))
        bins[r.pack_id].append(r)
    for (i, _), spans in places.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at and 0 < n <= capacity
            at += n
        assert at == tokens[i]
    for of in bins.values():
        assert sum(r.n_tokens for r in of) == of[0].pack_tokens <= capacity
        assert sorted(r.position for r in of) == list(range(len(of)))
    assert {i for i, _ in places} == {i for i, n in tokens.items() if n}
    return bins


def test_packs_hold_every_token_once(spark, sf, docs):
    rows = op5_packing(spark, sf).collect()
    d = [(r.doc_id, r.text) for r in docs.collect()]
    bins = check_packs(rows, d, P.CAPACITY)
    # one group: the very bins of plain best-fit decreasing
    pieces = [n for _, t in d for n in [P.CAPACITY] * (len(t.split()) // P.CAPACITY) + [len(t.split()) % P.CAPACITY] if n]
    assert len(bins) == len(plain_best_fit(pieces, P.CAPACITY))


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if sum(b) + s <= capacity]
        if fit:
            max(fit, key=sum).append(s)
        else:
            bins.append([s])
    return bins


def test_best_fit_is_best_fit():
    r = random.Random(8)
    for _ in range(30):
        sizes = [r.randint(1, 100) for _ in range(r.randint(0, 80))]
        got = P.best_fit(sizes, 100)
        assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(map(sum, plain_best_fit(sizes, 100)))


def test_tree_of_rounds(make):
    r = random.Random(2)
    rows = [(n, " ".join(["w"] * r.choice([3, 7, 20, 45, 60, 99, 250]))) for n in range(900)]
    got = P.pack(make(rows), capacity=100, group_tokens=4000).collect()
    bins = check_packs(got, rows, 100)
    pieces = [n for _, t in rows for n in [100] * (len(t.split()) // 100) + [len(t.split()) % 100] if n]
    # 60s can't share a bin, so the measure is plain best fit over everything at once
    assert len(bins) <= 1.03 * len(plain_best_fit(pieces, 100))
    # nothing to merge: a round that merges none ends the tree
    alone = [(n, " ".join(["w"] * 60)) for n in range(300)]
    assert len(check_packs(P.pack(make(alone), capacity=100, group_tokens=2000).collect(), alone, 100)) == 300


def test_packing_edges(make, edge_rows):
    rows = P.pack(make(edge_rows)).collect()
    assert {r.doc_id for r in rows} == {4, 5, 6, 7, 8, 9, -3}
    assert sorted(r.copy for r in rows if r.doc_id == 7) == [0, 1]
    assert sum(r.n_tokens for r in rows if r.doc_id == 8) == 80_000
    assert P.pack(make([])).count() == 0


def test_counts_are_those_of_whole_texts(spark, sf, docs):
    e = K.encoder(K.TOKENIZER)
    want = {r.doc_id: len(e.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in op7_token_counts(spark, sf).collect()} == want


def test_counts_of_odd_white_space(make):
    r = random.Random(6)
    bits = [" ", "  ", "\n", "\t", " ", "\r\n", "　", "a", "Word", "don't", "'s", "12", "345", "…", "é", "中文", "!!", "<|endoftext|>", "\x85", "\x1c", " ", "_", "🙂"]
    rows = [(n, "".join(r.choices(bits, k=r.randint(0, 14)))) for n in range(3000)]
    e = K.encoder(K.TOKENIZER)
    got = {x.doc_id: x.n_tokens for x in K.token_counts(make(rows)).collect()}
    assert [(t, got[n]) for n, t in rows if got[n] != len(e.encode_ordinary(t))] == []


def test_count_edges(make, edge_rows):
    e = K.encoder(K.TOKENIZER)
    got = sorted((r.doc_id, r.n_tokens) for r in K.token_counts(make(edge_rows)).collect())
    assert got == sorted((i, len(e.encode_ordinary(t or ""))) for i, t in edge_rows if i is not None)
    assert K.token_counts(make([])).count() == 0


def test_table_holds_the_frequent(make):
    rows = [(n, "the cat " * 50 + f"rare{n}") for n in range(50)]
    table = K.frequent_lengths(make(rows).select("text"), share=1e-3, table=10)
    assert {" the", " cat"} <= table.keys() and len(table) <= 10
