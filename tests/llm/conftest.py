from __future__ import annotations

import pytest


@pytest.fixture()
def nothing(spark):
    """An empty table of documents."""
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    common = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [
        (1, common, "en", "a"), (2, common, "en", "a"), (2, common, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, "x", "en", "b"), (6, "word " * 30_000, "en", "a"),
        (7, "été à la plage " * 40, "fr", "a"), (8, common + " and a tail that is its own", "en", "b"), (9, "12345 !!! ???", "en", "b"), (10, " \t\n ", "en", "b"), (11, "été à la plage " * 40, None, "a"), (12, "a" * 5000, "en", "c"),
    ]
    names = ["id", "h", "digest", "salt", "row", "fp", "key", "rank", "bucket", "starts", "pairs", "n"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(i, t, g, s, len(t or ""), *names) for i, t, g, s in rows], schema)


def rows_of(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: tuple(str(v).zfill(9) for v in (r[key],)))
