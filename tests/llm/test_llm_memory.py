"""What workers hold at once and what is moved, whatever the size of a batch or a table."""

from collections import Counter

import pandas as pd

from postsift.llm import op03_minhash_dedup as dedup
from postsift.llm import op09_secret_scans as secrets
from postsift.llm.common import parts


def test_batches_are_worked_on_in_parts():
    """What workers hold is bounded by a part, not by a batch: parts cover it in order, a large row is one alone."""
    texts = pd.Series(["ab", "", "c" * 9, "d", "e" * 4, "f" * 4, "g"])
    assert [list(part) for part in parts(texts, size=8)] == [["ab", ""], ["c" * 9], ["d", "e" * 4], ["f" * 4, "g"]]
    assert list(parts(texts.iloc[:0], size=8)) == []
    both = pd.DataFrame({"a": [b"1", b"22", b"333"], "b": [b"1", b"22", b"333"]})
    assert [list(part["a"]) for part in parts(both, "a", "b", size=6)] == [[b"1", b"22"], [b"333"]]


def test_a_batch_gives_tables_of_bounded_size():
    words = [" ".join(f"w{(i * 37 + j * j) % 5000}" for j in range(200)) for i in range(4000)]
    docs = pd.DataFrame({"doc_id": range(len(words)), "text": words})
    made = list(dedup._set_rows(5)(iter([docs])))
    assert [i for part in made for i in part["node"]] == list(range(len(words)))
    assert max(sum(map(len, part["shingles"])) for part in made) < 4 << 20 < sum(map(len, words))
    pairs = pd.DataFrame({"a": 1, "b": 2, "set_a": [row for part in made for row in part["shingles"]]})
    pairs["set_b"] = pairs["set_a"]
    found = list(dedup._verify(80)(iter([pairs])))
    assert sum(map(len, found)) == len(words) and max(map(len, found)) < len(words) / 4


def test_texts_without_candidates_are_not_shuffled(spark):
    """Only rows that hold a candidate meet what was found in the corpus; the others stay where they are."""
    rows = [(i, f"Text {i} without any.", 3, "s", "en") for i in range(300)] + [
        (300 + i, f"password = abcdefghijkl{i}m and more", 1, "s", "en") for i in range(3)
    ] + [(None, None, None, None, None), (7, "", 0, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, source string, lang string")
    found = secrets.redact(docs)
    assert Counter(map(tuple, found.collect())) == Counter([
        *rows[:300], *[(300 + i, "[secret] and more", 17, "s", "en") for i in range(3)], *rows[303:]
    ])
    both = found._jdf.queryExecution().optimizedPlan()
    assert both.nodeName() == "Union"
    marked, others = (both.children().apply(i).toString() for i in range(2))
    assert "Join" in marked and "Join" not in others and "Aggregate" not in others
