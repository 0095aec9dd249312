import pytest

SF = "/root/testdata/sf0.001"
#: Names that the operators and stages use for themselves.
CLASHING = ["quality_score", "_score", "_key", "_lang", "lang_pred", "_toxic", "toxic_score", "spans", "w0", "node", "component_id", "media", "feature", "ids", "tier", "shard_id", "prefix", "depth", "words", "block", "item_id", "_share", "_value", "carried", "kept_text", "lost", "lines", "top"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows and clashing column names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000)) + ".\n" + "x" * 5_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t\n", "en", "s", 4), (None, "No id here, but a line of some length.\nshort", "en", None, 9)]
    rows += [(4, "The same long line in all of these.\nA", "en", "s", 9)] * 2 + [(k, "  THE same long line in all of these. \nB", "de", "s", 9) for k in (5, 6)]
    rows += [(7, long, "en", "s", len(long)), (8, "Ünï 中文字 😂 mixed", "fr", "s", 9), (9, "42", "es", "s", 2)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.selectExpr("*", "'q' AS h1", "1 AS id", "2 AS fp", "3 AS n", "4 AS batch", "5 AS score", "6 AS label", "7 AS rid", "8 AS pos", *[f"'mine' AS {c}" for c in CLASHING]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
