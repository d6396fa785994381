import pytest

#: Texts with the odd cases that every operator must take.
ODD = [
    None, "", " ", "\n\t", "a", "İ É ß 😀 \U00010348", "x" * 5000, "tie tie tie tie tie tie", "tie tie tie tie tie tie",
    "nul\x00byte", "one two three four", "ONE two  three\tfour five", " lead and trail ", "Ünï cödé wörds ähm ja",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) rows, with extra columns whose names may clash."""

    def of(rows, parts=3):
        full = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows]
        schema = DOCS + ", spans string, component long"
        return spark.createDataFrame(full, schema).repartition(parts)

    return of


@pytest.fixture(scope="session")
def odd(make):
    rows = list(enumerate(ODD))
    return make([*rows, rows[5], (None, "no id")])
