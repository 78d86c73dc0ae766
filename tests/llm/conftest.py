import pytest

WORDS = [f"w{i}" for i in range(400)]

# Columns of the operators' own, to clash with.
EXTRA = ["words", "score", "kept", "key", "node", "root", "answers", "runs", "spans", "hash", "at", "text_key", "ids", "base"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, blanks, a long text, repeated rows, equal texts, and clashing columns."""
    long = " ".join(f"{WORDS[i * i % 397]}{i % 7}" for i in range(40_000))
    rows = [
        (1, None, "en", "s1"),
        (2, "", "en", "s1"),
        (3, " \t\n ", None, None),
        (4, "a", "en", "s2"),
        (5, long, "en", "s2"),
        (6, "One sentence of some nine words stands right here. And another one comes after it, long too.", "en", "s3"),
        (7, "One sentence of some nine words stands right here. And another one comes after it, long too.", "en", "s4"),
        (7, "One sentence of some nine words stands right here. And another one comes after it, long too.", "en", "s4"),
        (None, "A text without an id, with password = abcdefghijklmnop in it.", "de", "s5"),
        (9, "Größe \U0001f600 und Maß: token='ABCDEFGHIJKLMNOPQRST12' 中文", None, "s5"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(a, b, c, d, None if b is None else len(b), *EXTRA) for a, b, c, d in rows], schema).cache()


def rows_by_id(df, key="doc_id"):
    found = {}
    for row in df.collect():
        found.setdefault(row[key], []).append(row)
    return found
