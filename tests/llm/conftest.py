import random

import pytest

WORDS = [a + b + c for a in ("ba", "ko", "ri", "tu", "ne") for b in ("la", "mo", "si", "fe") for c in ("n", "r", "st", "")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def prose():
    """Seeded random words."""
    def make(n, seed):
        return " ".join(random.Random(seed).choices(WORDS, k=n))
    return make


@pytest.fixture
def documents(spark, tmp_path_factory):
    """A table of (doc_id, text), with some columns whose names the operators use themselves."""
    def make(rows, extra=False):
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, COLUMNS)
        if extra:
            used = ["_spans", "_hash", "_id", "_text_hash", "__key", "kept_id", "kept_key", "_0", "__0", "mixing_source", "in_0", "in_1"]
            df = df.selectExpr("*", "'x' as removed", "1 as probability", "2 as leaks", "3 as key", "4 as p_toxic", "5 as count", "6 as `odd name`",
                               *[f"7 as `{c}`" for c in used])
        return df
    return make


@pytest.fixture
def odd(prose):
    """Nulls, empty and blank texts, ties, repeated rows and one very long text."""
    same = prose(80, 1)
    return [(1, same), (2, same), (2, same), (3, None), (4, ""), (5, " \n\t "), (None, prose(70, 2)), (None, None),
            (6, "x"), (7, "one two three"), (8, prose(60_000, 3)), (9, "ünï çødé 文字 \U0001f600 text"), (10, "a" * 100_000)]
