import pytest

from swimlane.llm import toxicity as T
from swimlane.llm.queries import op3_toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def nearest(word, terms):
    """By the plain definition: the term of fewest edits, if they are allowed."""
    best = None
    for t in sorted(terms):
        if t.endswith("*"):
            e = 0 if word.startswith(t[:-1]) else 9
        else:
            e = distance(word, t) if word[:1] == t[:1] and len(word) > 0 else 9
            # the first letter is not edited
            if e < 9:
                e = distance(word[1:], t[1:])
        if e <= T.allowed(t) and (best is None or (e, t) < (best[1], best[0])):
            best = (t, e)
    return best


@pytest.fixture(scope="module")
def model(spark, sf):
    return T.learn_lexicon(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_automaton_is_levenshtein():
    terms = dict.fromkeys(["idiot", "stupid", "scum", "moron", "lowei*", "imbécil", "loser", "loser*", "scum*"], 1.0)
    lex = T.Lexicon(terms)
    words = ["idiot", "idot", "idiiot", "idiom", "odiot", "xidiot", "stupd", "stupida", "stupidity", "scum", "scam", "scums", "moro", "loweihr", "lowei", "lowe", "imbecil", "imbécile", "m", "", "morons", "maron", "mmoron", "loserish", "losr"]
    for w in words:
        assert lex.walk(w) == nearest(w, terms), w


def test_query_equals_brute_force(spark, sf, model, docs):
    lex = T.Lexicon(model.terms, model.rates)
    want = {}
    for r in docs.collect():
        raw = r.text.split()
        bare = [T.strip(w) for w in raw]
        hits = [(i, nearest(T.fold(w), lex.severity)) for i, w in enumerate(bare) if len(w.encode()) >= 3]
        hits = [(i, f) for i, f in hits if f]
        total = -lex.natural * len(raw)
        for i, (term, e) in hits:
            near = {x.lower() for x in bare[max(0, i - 6) : i] + bare[i + 1 : i + 7]}
            w = lex.severity[term] * (T.FUZZY if e else 1)
            w *= 0.25 if any(q in raw[i] for q in T.QUOTES) else 0.5 if near & T.REPORTING else 1
            total += w * (1.25 if near & T.ADDRESS else 1)
        if hits and round(total, 6) >= model.threshold:
            want[r.doc_id] = (pytest.approx(total, abs=1e-5), len(hits))
    got = {r.doc_id: (r.score, r.n_terms) for r in op3_toxicity(spark, sf).collect()}
    assert got == want and want


def test_held_out_accuracy(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", "toxic", "text").collect()]
    r = sorted((t, i, x) for i, t, x in rows if i % 2)
    m = T.fit([(t, x) for t, _, x in r[-800:] + r[:800]])
    lex = m.lexicon()
    said = [(lex.score(x)[0] >= m.threshold, t) for i, t, x in rows if i % 2 == 0]
    caught = [s for s, t in said if t]
    assert sum(caught) / len(caught) >= 0.85
    assert sum(s for s, t in said if not t) / sum(not t for _, t in said) <= 0.02


def test_context(make):
    rows = [(1, "you are an idiot and a moron"), (2, 'the word "idiot" is quoted here'), (3, "nothing at all"), (4, "what an 1d1ot, you stupidd"), (5, "he said idiot"), (6, "IDIOT! MORON!")]
    got = {r.doc_id for r in T.toxic_scores(make(rows)).collect()}
    assert got == {1, 4, 6}
    assert {r.doc_id for r in T.drop_toxic(make(rows)).collect()} == {2, 3, 5}


def test_edges(spark, make, edge_rows, model):
    df = make(edge_rows)
    assert T.toxic_scores(df, model).count() == 0
    kept = T.drop_toxic(df, model)
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect())) and kept.columns == df.columns
    assert T.toxic_scores(make([])).count() == 0 and T.drop_toxic(make([])).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.learn_lexicon(df, none).terms == T.LEXICON
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (5, 1), (5, 1), (6, 0)], "doc_id long, toxic int")
    assert T.learn_lexicon(df, odd).threshold >= T.THRESHOLD
    twice = [r.doc_id for r in T.toxic_scores(make([(1, "stupid idiot"), (1, "stupid idiot"), (None, "stupid idiot")])).collect()]
    assert twice == [1, 1]


def test_marks_at_the_ends(make):
    rows = [(1, "what a moron!!"), (2, "moron$$$ that"), (3, "such scum! there"), (4, "!!scum!!! there"), (5, "$tupid as ever"), (6, "!diot as ever"), (7, "so b!tch"), (8, "cheap at 300$ !! or $$$ !"), (9, "moron!")]
    got = {r.doc_id: tuple(r.terms) for r in T.toxic_scores(make(rows)).collect()}
    assert got == {1: ("moron",), 2: ("moron",), 3: ("scum",), 4: ("scum",), 5: ("stupid",), 6: ("idiot",), 7: ("bitch",), 9: ("moron",)}
    assert {r.doc_id for r in T.drop_toxic(make(rows)).collect()} == {8}


def test_quotation_over_several_words(make):
    rows = [
        (1, '"you are an idiot today" he shouted'), (2, "you idiots' club"), (3, "il a dit connard"), (4, "er nannte ihn „ein dummer Dummkopf“ und ging"), (5, "«quel connard» a-t-il crié"), (6, "'what an idiot' she thought"),
        (7, "you idiot's fool"), (8, "you idiot’s"), (9, 'say "hello" you idiot and "go"'), (10, "the moron's car, it's the dog's"), (11, '"a mark that is never closed, you idiot'), (12, "dijo la palabra pendejo"), (13, "tu es un connard"),
    ]
    got = {r.doc_id for r in T.toxic_scores(make(rows)).collect()}
    assert got == {7, 8, 9, 10, 11, 13}
    assert T.quoted('a "b c" d "e" f \'g h\' i\' "j'.split()) == [False, True, True, False, True, False, True, True, False, False]


def test_threshold_is_of_rows_that_did_not_teach(spark, sf):
    rows = [(n % 2, f"the a{n} {'zworble' if n % 4 == 1 else 'plain'} b{n} number{n} of the sample and so on") for n in range(400)]
    m = T.fit(rows)
    assert any(t.startswith("zwor") for t in m.terms) and m.threshold >= T.THRESHOLD
