from pathlib import Path

import duckdb
import pytest

from swimlane.llm.queries import QUERIES, SQL


def plain(v):
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    with duckdb.connect() as c:
        for t in ("documents", "pages", "benchmark"):
            p = Path(sf, f"{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
        o = c.execute(SQL[name])
        names = [x[0] for x in o.description]
        want = [tuple(plain(r[names.index(k)]) for k in cols) for r in o.fetchall()]
    got = [tuple(plain(r[k]) for k in cols) for r in df.collect()]
    assert sorted(names) == cols and sorted(got, key=str) == sorted(want, key=str) and got


def test_pipeline_against_plain_definitions_and_sql(spark, sf):
    """Toxicity by its plain definition, the other stages as SQL, one after another."""
    from test_toxicity import nearest

    import corpus_pipeline
    from swimlane.llm import toxicity as T

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = T.learn_lexicon(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    terms, natural = {T.fold(t): s for t, s in model.terms.items()}, 3 * sum(r * model.terms[t] for t, r in model.rates.items())
    toxic = [-1]
    for r in docs.collect():
        bare = [T.strip(w) for w in r.text.split()]
        total, hits = -natural * len(bare), 0
        for i, w in enumerate(bare):
            found = nearest(T.fold(w), terms) if len(w.encode()) >= 3 else None
            if found:
                near = {x.lower() for x in bare[max(0, i - 6) : i] + bare[i + 1 : i + 7]}
                total += terms[found[0]] * (T.FUZZY if found[1] else 1) * (0.5 if near & T.REPORTING else 1) * (1.25 if near & T.ADDRESS else 1)
                hits += 1
        if hits and round(total, 6) >= model.threshold:
            toxic.append(r.doc_id)
    with duckdb.connect() as c:
        p = Path(sf, "documents.parquet")
        c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{Path(sf, 'benchmark.parquet')}'")
        c.execute(f"CREATE TABLE documents AS SELECT * FROM '{f'{p}/*.parquet' if p.is_dir() else p}' WHERE doc_id NOT IN ({', '.join(map(str, toxic))})")
        for step in (SQL["op2_line_dedup"], f"SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({SQL['op6_simhash']}))", f"SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({SQL['op1_decontamination']}))"):
            c.execute(f"CREATE TABLE next AS {step}")
            c.execute("DROP TABLE documents")
            c.execute("ALTER TABLE next RENAME TO documents")
        o = c.execute(SQL["op5_packing"])
        names = [x[0] for x in o.description]
        want = o.fetchall()
    df = corpus_pipeline.run(spark, sf)
    got = [tuple(r[k] for k in names) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(toxic) > 1
