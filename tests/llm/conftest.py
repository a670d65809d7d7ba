import pytest

LONG = "lorem ipsum dolor " * 12_000
PASSAGE = " ".join(f"word{i}" for i in range(120))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, extra columns of names that operators use."""
    rows = [
        (1, "hello there world", "en", "s1"), (1, "hello there world", "en", "s1"), (2, None, None, None), (None, "hello there world", "en", "s2"), (3, "", "en", "s1"), (3, "another text of the same id", "de", "s3"),
        (4, LONG, "en", "s1"), (None, None, None, None), (5, "   \n \t\n", "en", None), (6, PASSAGE + "\n日本語 🙂 é", "fr", "s1"), (7, PASSAGE + "\n日本語 🙂 e", "fr", "s2"), (8, "x" * 50_000, None, "s2"), (9, "Aa1 +1 (017) 555-7713 a@b.cd", "es", "s3"), (None, None, None, None),
    ]
    extra = "score double, hits string, n_removed string, n_lines string, label string, node string, version string, key string, ids string, decoded string, place string, at string"
    full = [(i, t, la, s, None if t is None else len(t), 0.5, *["extra"] * 11) for i, t, la, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
