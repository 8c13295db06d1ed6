import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of documents with extra columns whose names clash with the
    operators' own."""

    def make(rows, schema="doc_id long, text string", parts=3):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        for c in ("row", "keep", "n_lines", "shard", "n", "th", "dk", "h1", "words", "kind", "id", "spans", "ids"):
            if c not in df.columns:
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
