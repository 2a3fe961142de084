import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()

#: Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
    (2, "ALPHA beta gamma delta  epsilon\nzeta", "en", None),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \t\n", "de", "b"),
    (None, "alpha beta gamma delta epsilon zeta", "de", "c"),
    (None, None, None, None),
    (6, "one", "de", "c"),
    (7, "one", None, "c"),
    (8, " ".join(WORDS * 3000), "en", "a"),
    (9, "x" * 300_000, "fr", "a"),
    (10, "\U0001d400éİ 123 中文", "fr", "b"),
]
CLASH = "node long, bucket long, hub long, score double, label int, size long, host string, n long, src int, block long, tkey long, gone long"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with clashing extra columns."""
    extra = tuple(None for _ in CLASH.split(","))
    return spark.createDataFrame([(*r, 0, *extra) for r in ODD], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def tables(spark, data):
    return lambda name: spark.read.parquet(f"{data}/{name}.parquet")
