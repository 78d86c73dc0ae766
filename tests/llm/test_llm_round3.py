"""Merkle proofs, personal data and periodic runs against plain answers."""

import hashlib
import random
import re
import zlib
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postsift import llm
from postsift.llm import op11_merkle_manifest as merkle
from postsift.llm import op12_pii_crf as pii
from postsift.llm import op13_periodic_runs as periodic
from postsift.llm.common import bucket_of

from .conftest import rows_by_id

SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# Merkle manifest


def plain_leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_proofs(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, as a sorted list."""

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][i : i + 8])) for i in range(0, len(found[-1]), 8)])
        return found

    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in order:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
    trees = {lang: levels([plain_leaf(r, r["text"]) for r in groups[lang]]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order]) if order else []
    lower = {i: i + 32 for i in range(65, 91)}
    found = []
    for place, lang in enumerate(order):
        for rank, row in enumerate(groups[lang]):
            text = row["text"]
            key = "" if row["doc_id"] is None else str(row["doc_id"])
            if zlib.crc32(key.encode()) % 3 == 0 and text is not None:
                text = text.translate(lower)
            node, proof = plain_leaf(row, text), ""
            for tree, at in ((trees[lang], rank), (top, place)):
                for level in tree[:-1]:
                    first = at // 8 * 8
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 8])
                    node, proof, at = sha(left + node + right), proof + left + right, at // 8
            root = top[-1][0]
            found.append((row["doc_id"], plain_leaf(row, row["text"]), trees[lang][-1][0], root, sha(proof), node, node == root))
    return sorted(found, key=str)


def proofs(df):
    found = merkle.verify_rows(df, bucket_of("doc_id", 3) == 0)
    rows = found.collect()
    assert all(row["reached"] for row in rows)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(row[n] for n in names) for row in rows), key=str)


def test_merkle_edges(spark, edge_docs):
    assert proofs(edge_docs) == plain_proofs([r.asDict() for r in edge_docs.collect()])
    assert merkle.verify_rows(edge_docs.limit(0), F.lit(False)).collect() == []


def test_merkle_one_row_is_its_own_root(spark, edge_docs):
    single = edge_docs.where("doc_id = 6")
    (row,) = merkle.verify_rows(single, F.lit(False)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"]
    assert row["proof_sha256"] == sha("")


def test_merkle_shapes_and_layouts(spark):
    """Groups of 1, 8, 9, 64, 65 and 520 leaves, a third of all rows alike, in two layouts."""
    rows = [(i, f"text {i}", lang, "s", 6) for lang, n in [("a", 1), ("b", 8), ("c", 9), ("d", 64), (None, 65), ("é", 520)] for i in range(n)]
    rows += [(7, "The same row", "é", "s", 12)] * 300
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, schema)
    want = plain_proofs([r.asDict() for r in df.collect()])
    assert proofs(df) == want
    assert proofs(df.repartition(7, "text")) == want


def test_merkle_requests_descend_alone(spark):
    rows = [(i, f"text {i}", "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    manifest = merkle.build_manifest(df.select("doc_id", "lang", merkle.leaf_of([F.col("doc_id"), F.col("text")]).alias("leaf")))
    asked = manifest.leaves.where("doc_id IN (5, 77)")
    some = {r["doc_id"]: r["path"] for r in merkle.prove(manifest, asked).collect()}
    every = {r["doc_id"]: r["path"] for r in merkle.prove(manifest).collect()}
    assert set(some) == {5, 77} and len(every) == 200
    assert all(some[i] == every[i] for i in some)


def test_merkle_change_shows(spark):
    df = spark.createDataFrame([(i, f"T{i}", "a", "s", 2) for i in range(30)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = rows_by_id(merkle.verify_rows(df, F.col("doc_id") == 4))
    assert [i for i in sorted(found) if not found[i][0]["verified"]] == [4]


# Personal data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_base(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            checks = [True, False, False, 9 <= len(digits) <= 15]
            if kind == 1:
                checks[1] = all(int(part) <= 255 for part in match[0].split("."))
            if kind == 2 and 13 <= len(digits) <= 19:
                doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
                checks[2] = sum(sum(divmod(d, 10)) for d in doubled) % 10 == 0
            if checks[kind]:
                found.append((kind, match.start(), match.end()))
    return found


PIECES = ["a", "_", "%", ".", "..", "@", "1", "25", "300", "+1", " ", "-", "(", ")", "\n", "é", "4111111111111111", "x.y@b.co", "1.2.3.4"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_base_spans(text):
    good, failed = pii.matches(text)
    assert good == plain_base(text)
    words = pii.words_in(text, good, failed)
    assert all(0 <= a <= b <= len(text) for a, b in words.places.tolist())


def test_base_spans_of_long_texts_are_quick():
    for sign in ("1", "a", ".", "@", "+1", "1.", "a@", "é"):
        text = sign * 300_000
        good, failed = pii.matches(text)
        pii.words_in(text, good, failed)
    assert pii.matches("9" * 5_000 + ".1.1.1")[0] == []


def test_messages_are_exact_without_loops():
    """Every labelling of four words, two of them alike, weighed one by one."""
    rng = np.random.default_rng(5)
    field = pii.Field(
        rng.normal(size=(pii.BUCKETS, pii.N_LABELS)).astype(np.float32),
        rng.normal(size=(pii.N_LABELS, pii.N_LABELS)), np.abs(rng.normal(size=1 + len(pii.KINDS))),
    )
    text = "a1 b2 word a1"
    words = pii.words_in(text, [], [])
    assert words.linked.tolist() == [0, 1, 0]
    text_of = np.zeros(3, int)
    own = field.unary[words.features].sum(1).astype(float)
    own[words.linked == 0, 2::2] -= pii.CERTAIN
    weight = np.full((3, pii.N_LABELS), -np.inf)
    for a, b, c in product(range(pii.N_LABELS), repeat=3):
        score = own[0, a] + own[1, b] + own[2, c] + field.chain[a, b]
        # Words 0 and 2 share a hidden node.
        shared = [sum(field.skip[k] * (pii.KIND_OF[x] == k) for x in (a, c)) for k in range(1 + len(pii.KINDS))]
        score += np.logaddexp.reduce(shared)
        for i, label in enumerate((a, b, c)):
            weight[i, label] = np.logaddexp(weight[i, label], score)
    want = weight - np.logaddexp.reduce(weight, axis=1)[:, None]
    assert np.allclose(field.marginals(words, text_of), want, atol=1e-5)


@pytest.fixture(scope="module")
def personal(spark):
    """300 texts with one entity each; in the last ones two run together, so that patterns fail."""
    rng = random.Random(4)

    def card():
        digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        return next(digits + str(d) for d in range(10) if pii._luhn(digits + str(d)))

    def phone():
        return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    makers = [lambda: f"w{rng.randrange(99)}.x@mail.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card, phone]
    say = lambda: " ".join(rng.choice(["the", "of", "and", "number", "is", "for"]) for _ in range(rng.randrange(3, 9)))
    rows = [(i, f"{say()} {makers[i % 4]()} {say()} version {rng.randrange(9)}.0 {say()}") for i in range(300)]
    rows += [(1000 + i, f"{say()} {phone()} {card()} {say()}") for i in range(5)]
    known = card()
    rows += [(2000, f"{say()} {known} {say()} {known} {known} {say()}")]
    rows += [(3000, None), (3001, ""), (None, "no id 1.2.3.4 here"), (3002, "plain"), (3002, "plain")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_field_finds_what_patterns_leave_open(personal):
    texts = {r["doc_id"]: r["text"] for r in personal.collect()}
    found = rows_by_id(pii.find_personal_data(personal))
    for i in range(1000, 1005):
        (row,) = found[i]
        assert row["base"] == [] and [s["kind"] for s in sorted(row["added"], key=lambda s: s["start"])] == [3, 2]
        number = [texts[i][s["start"] : s["end"]] for s in row["added"] if s["kind"] == 3]
        assert re.fullmatch(r"\+1 \(\d+\) 555-\d+", number[0])
    # A number seen alone tells what its copies are.
    assert len(found[2000][0]["base"]) == 1 and len(found[2000][0]["added"]) == 2
    # "version 3.0" stays outside.
    assert not any(row["added"] for i in range(300) for row in found[i])


def test_personal_data_columns(personal):
    texts = {r["doc_id"]: r["text"] or "" for r in personal.collect()}
    found = rows_by_id(pii.find_personal_data(personal))
    assert {i: len(rows) for i, rows in found.items() if len(rows) > 1} == {3002: 2}
    for i, (row, *_) in found.items():
        base = plain_base(texts[i])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert row["base_sha256"] == sha(joined)
        assert [row[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == s[0] for s in base) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(","))
    assert found[3000][0]["spans"] == found[3001][0]["spans"] == ""


def test_personal_data_edges(spark, edge_docs):
    found = pii.find_personal_data(edge_docs)
    assert found.count() == edge_docs.count()
    assert pii.find_personal_data(edge_docs.limit(0)).collect() == []
    again = pii.find_personal_data(edge_docs.repartition(5, "n_chars"))
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))


# Periodic runs


def plain_runs(words):
    least = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j - i + period >= max(12, 2 * period):
                least.setdefault((i, j + period), period)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in least.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def repeating(rng, n):
    words = [b"%d" % rng.randrange(4) for _ in range(rng.choice([1, 2, 5, 9, 40]))]
    while len(words) < n:
        step = rng.random()
        if step < 0.6:
            words = words * rng.choice([2, 3])
        elif step < 0.8:
            words = words + words[: rng.randrange(len(words) + 1)]
        else:
            words = words + [b"%d" % rng.randrange(5)]
    return words[:n]


def test_runs_against_brute_force():
    rng, total = random.Random(8), 0
    for _ in range(250):
        texts = [repeating(rng, rng.choice([0, 11, 40, 150, 400])) for _ in range(rng.choice([1, 4]))]
        for words, found in zip(texts, periodic.runs_of(texts), strict=True):
            want = plain_runs(words)
            assert found == want
            assert periodic.collapsed(words, found) == plain_collapsed(words, want)
            total += len(want)
    assert total > 1_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=120))
def test_runs_of_any_text(words):
    assert periodic.runs_of([words]) == [plain_runs(words)]


def test_long_texts_take_time_in_proportion():
    """One word over and over, and one text without end of ever longer periods."""
    assert periodic.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 60_000:
        a, b = b, b + a
    assert len(periodic.runs_of([b])[0]) > 10_000
    word = [b"%d" % i for i in range(20_000)]
    assert periodic.runs_of([word * 3 + [b"x"]]) == [[(0, 60_000, 20_000)]]


def test_periodic_query(spark):
    if not Path(SF).exists():
        pytest.skip("tables are not here")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    planted = 0
    for row in llm.queries()["op13_periodic_runs"](spark, SF).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (texts[row["doc_id"]] or "").encode())
        n, h = len(words), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert tuple(row) == (row["doc_id"], len(runs), *longest, sha(lines), sha(b" ".join(plain_collapsed(words, runs))))
    assert planted


def test_periodic_edges(spark, edge_docs):
    found = rows_by_id(periodic.periodic_runs(edge_docs))
    assert sum(map(len, found.values())) == edge_docs.count() and len(found[7]) == 2
    assert [found[i][0]["n_words"] for i in (1, 2, 3)] == [0, 0, 0]
    assert found[3][0]["collapsed"] == "" and found[1][0]["runs"] == []
    kept = periodic.periodic_runs(edge_docs, keep=["words", "runs2"][:1])
    assert kept.where("words <> 'words'").count() == 0
    assert periodic.periodic_runs(edge_docs.limit(0)).collect() == []
    digested = rows_by_id(periodic.digests(periodic.periodic_runs(edge_docs)))
    assert digested[2][0]["runs_sha256"] == sha("") and digested[2][0]["length"] is None
