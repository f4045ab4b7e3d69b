import pytest

from llm_corpus import corpus


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with extra columns whose names clash with the operators' own."""
    clash = ["size", "key", "label", "copy", "n", "h1", "digest", "norm", "taken", "range", "cell", "doc", "at", "score"]
    schema = "doc_id long, text string, source string"
    rows = [(*r, *["x"] * len(clash)) for r in corpus()]
    return spark.createDataFrame(rows, schema + "".join(f", {c} string" for c in clash)).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
