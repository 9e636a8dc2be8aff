import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with columns called like the operators' own."""

    def build(rows, extra=True):
        full = [(i, t, None, "s", len(t) if t else None) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            names = "tk h key node s0 s1 root g n size copy pieces runs first last swl_tk swl_cut swl_r_id swl_gone_id swl_nth item_id kept_id chunk start before".split()
            df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
        return df

    return build


LONG = " ".join(f"word{i} of{i % 97}" for i in range(40_000))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, blanks, one token, ties, repeated rows and a very long text."""
    return [(None, "a null id with some words"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text twice here"), (6, "same text twice here"), (7, "row"), (7, "row"), (8, LONG), (9, "ünïcode – text … 中文 字"), (-3, "negative id")]
