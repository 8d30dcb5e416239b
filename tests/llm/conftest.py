import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, "a b c d"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, long), (5, long), (5, long), (6, "a b c d"), (7, " \n\t "), (8, "x" * 20_000), (9, "é \x1c ü　Σ 👍 <|endoftext|>  \n b")]
    extra = "fp long, places string, places_ string, run int, anchor int, score double, toxicity_score double, repeat_text int, component_id int, lang string, n_chars long"
    return spark.createDataFrame([(i, t, *[None] * 11) for i, t in rows], f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
