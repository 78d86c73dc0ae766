"""Personal data: patterns, and a skip-chain conditional random field over what they leave open.

Base spans come from four patterns. The field labels the words that hold a digit or an ``@`` (no
other word can be part of an entity, so its label is known): outside, or the beginning or inside of
an email, ip, card or phone. Words that follow one another are linked. So are distant words of a
document that repeat or resemble each other: equal apart from signs around them, equal digits, the
same mail domain. Such a group has one hidden node in its middle, which its members share a
potential with; that takes as many links as words, however large a group is. Words in base spans
are evidence, and loopy message passing carries it along the links, so that a document's repeated
entities get one label. A word in a match that failed its check (two numbers run together, say) is
neither entity nor outside; the field decides. Words it labels become further spans.

The weights are learned by pseudo-likelihood from base spans: words in them have their labels, words
in failed matches none. The sample has about ``max_words`` words, of documents chosen by hash; that
bounds what the driver holds. Every document is scanned and labelled, each text once, whole; what is
written and read again are the words with digits alone. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.storage import written

from .common import whole

KINDS = ["email", "ip", "card", "phone"]
N_LABELS = 1 + 2 * len(KINDS)  # outside, then beginning and inside of each kind
KIND_OF = np.array([0] + [1 + k for k in range(len(KINDS)) for _ in range(2)])
UNKNOWN = -1

MAX_WORDS = 200_000  # words that weights are learned from
MAX_TEXT_WORDS = 2_000  # of texts that have no more of them
BUCKETS = 1 << 14  # weights are found by hashed feature
N_FEATURES = 9
N_KEYS = 3
STEPS = 12  # rounds of message passing
BLOCK_WORDS = 50_000  # words labelled at once; a text with more is a block of its own
CERTAIN = 30.0  # potential of a label that is known

# The patterns, written so that none scans a long text more than once.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACTIVE = re.compile("[0-9@]")
_BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")
# A word without the signs around it.
_CORE = re.compile(r"[0-9A-Za-z+(](?:.*[0-9A-Za-z])?", re.S)


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Leftmost matches; what is before an ``@`` goes back as far as the last match lets it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if domain and start < at:
            end = domain.end()
            yield start, end, True
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four parts at a time of every chain of numbers and dots."""
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts, at = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in four)
            at = end + 1


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        yield match.start(), match.end(), 13 <= len(digits) <= 19 and _luhn(digits)


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for match in _PHONE.finditer(text):
        yield match.start(), match.end(), 9 <= sum("0" <= c <= "9" for c in match[0]) <= 15


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of base spans by kind, then start; and (start, end) of failed matches.

    A failed card of few digits is a plain number, not an entity in doubt.
    """
    good, failed = [], []
    if not _ACTIVE.search(text):
        return good, failed
    for kind, found in enumerate((_emails, _ips, _cards, _phones)):
        for start, end, holds in found(text):
            if holds:
                good.append((kind, start, end))
            elif kind != 2 or end - start > 19:
                failed.append((start, end))
    return good, failed


def _shape(word: str, exact: bool) -> str:
    kinds = "".join("9" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "u" if c > "\x7f" else c for c in word[:64])
    return f"{kinds}{len(word)}" if exact else re.sub(r"(.)\1+", r"\1", kinds)


def _core(word: str) -> tuple[int, str]:
    found = _CORE.search(word)
    return (found.start(), found[0]) if found else (0, word)


def _hash(*parts: object) -> int:
    return crc32(repr(parts).encode())


@dataclass
class Words:
    """Words with a digit or ``@`` of some texts: hashed features, label, whether the word before
    is one too, keys of words that resemble it, and its place."""

    features: np.ndarray
    labels: np.ndarray
    linked: np.ndarray
    keys: np.ndarray
    places: np.ndarray


def _bounds(text: str) -> list[tuple[int, int]]:
    bounds, end = [], 0
    for match in _ACTIVE.finditer(text):
        if match.start() >= end:
            start = text.rfind(" ", end, match.start()) + 1 or end
            end = text.find(" ", match.start())
            end = len(text) if end < 0 else end
            bounds.append((start, end))
    return bounds


def _beside(text: str, at: int, step: int) -> str:
    """The word before or after a place; long ones are told by the 32 signs that are nearest."""
    while 0 <= at < len(text) and text[at] == " ":
        at += step
    end = at
    while 0 <= end < len(text) and text[end] != " " and abs(end - at) < 32:
        end += step
    return text[at:end] if step > 0 else text[end + 1 : at + 1]


def words_in(text: str, good: list[tuple[int, int, int]], failed: list[tuple[int, int]]) -> Words:
    text = text.translate(_BLANKS)
    bounds = _bounds(text)
    labels = np.zeros(len(bounds), np.int8)
    starts, ends = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    def covered(start: int, end: int) -> slice:
        return slice(int(np.searchsorted(ends, start, "right")), int(np.searchsorted(starts, end)))

    for start, end in failed:
        labels[covered(start, end)] = UNKNOWN
    for kind, start, end in reversed(good):
        held = covered(start, end)
        labels[held] = 2 + 2 * kind
        labels[held.start] = 1 + 2 * kind
    features, keys = np.zeros((len(bounds), N_FEATURES), np.int32), np.zeros((len(bounds), N_KEYS), np.int64)
    linked, places = np.zeros(len(bounds), np.int8), np.zeros((len(bounds), 2), np.int64)
    for i, (start, end) in enumerate(bounds):
        word = text[start:end]
        skipped, core = _core(word)
        places[i] = start + skipped, start + skipped + len(core)
        digits = "".join(c for c in core if "0" <= c <= "9")
        before, after = _beside(text, start - 1, -1), _beside(text, end, 1)
        parts = core.split(".")
        linked[i] = i > 0 and text[bounds[i - 1][1] : start].isspace()
        features[i] = [h % BUCKETS for h in (
            _hash("shape", _shape(core, False)), _hash("exact", _shape(core, True)),
            _hash("digits", min(len(digits), 24), len(digits) == len(core)),
            _hash("number", 13 <= len(digits) <= 19 and _luhn(digits), len(digits) == len(core)),
            _hash("parts", len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)),
            _hash("signs", "@" in core, core[:1] in "+(", core[:1] == "+", "." in core, "-" in core),
            _hash("before", _shape(_core(before)[1], False) if _ACTIVE.search(before) else before.lower()),
            _hash("after", _shape(_core(after)[1], False) if _ACTIVE.search(after) else after.lower()),
            _hash("bias"),
        )]
        keys[i] = [
            _hash("word", core.lower()) + 1,
            _hash("digits", digits) + 1 if len(digits) >= 7 else 0,
            _hash("domain", core.rpartition("@")[2].lower()) + 1 if "@" in core else 0,
        ]
    return Words(features, labels, linked, keys, places)


def _groups(keys: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(word, group) of every word that shares a key with another one of its text, and the number of groups."""
    words, nodes, total = [], [], 0
    for k in range(keys.shape[1]):
        with_key = np.flatnonzero(keys[:, k])
        _, group, size = np.unique(
            np.column_stack((text_of[with_key], keys[with_key, k])), axis=0, return_inverse=True, return_counts=True
        )
        group = group.reshape(-1)
        shared = size[group] > 1
        numbers = np.cumsum(size > 1) - 1
        words.append(with_key[shared])
        nodes.append(numbers[group[shared]] + total)
        total += int((size > 1).sum())
    return np.concatenate(words), np.concatenate(nodes), total


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _normal(x: np.ndarray) -> np.ndarray:
    return x - _log_sum(x, 1)[:, None]


def _passed(sent: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Messages over links with a potential (sender's label, receiver's label)."""
    return _normal(np.column_stack([_log_sum(sent + column, 1) for column in potential.T]))


@dataclass(frozen=True)
class Field:
    """Weights: of features (bucket, label), of neighbours (label, next label), of groups (kind)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, words: Words, text_of: np.ndarray, steps: int = STEPS) -> np.ndarray:
        """Log probabilities of the labels of each word, by message passing along all links at once.

        Exact where links form no loops and ``steps`` is at least their longest path.
        """
        n = len(words.labels)
        own = self.unary[words.features].sum(1)
        # Nothing goes on in a word that follows none.
        own[words.linked == 0, 2::2] -= CERTAIN
        known = np.flatnonzero(words.labels >= 0)
        # Only entities are evidence: a word outside all matches may still be one.
        known = known[words.labels[known] > 0]
        own[known, words.labels[known]] += CERTAIN
        right = np.flatnonzero(words.linked)
        left = right - 1
        member, group, n_groups = _groups(words.keys, text_of)
        skip = np.zeros((N_LABELS, 1 + len(KINDS)))
        skip[np.arange(N_LABELS), KIND_OF] = self.skip[KIND_OF]
        to_right, to_left = np.zeros((len(right), N_LABELS)), np.zeros((len(right), N_LABELS))
        to_group, to_member = np.zeros((len(member), skip.shape[1])), np.zeros((len(member), N_LABELS))
        for _ in range(steps):
            belief = self._beliefs(own, n, right, left, member, to_right, to_left, to_member)
            new_right = _passed(belief[left] - to_left, self.chain)
            new_left = _passed(belief[right] - to_right, self.chain.T)
            new_group = _passed(belief[member] - to_member, skip)
            pooled = np.zeros((n_groups, skip.shape[1]))
            np.add.at(pooled, group, to_group)
            new_member = _passed(pooled[group] - to_group, skip.T)
            to_right, to_left, to_group, to_member = new_right, new_left, new_group, new_member
        return _normal(self._beliefs(own, n, right, left, member, to_right, to_left, to_member))

    @staticmethod
    def _beliefs(own, n, right, left, member, to_right, to_left, to_member) -> np.ndarray:
        belief = own.copy()
        belief[right] += to_right
        belief[left] += to_left
        np.add.at(belief, member, to_member)
        return belief


def learn(words: Words, text_of: np.ndarray, *, rounds: int = 300, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Weights of highest pseudo-likelihood: each word given its features and its linked words."""
    unary, chain, skip = np.zeros((BUCKETS, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros(1 + len(KINDS))
    member, group, n_groups = _groups(words.keys, text_of)
    known = words.labels >= 0
    one = np.zeros((len(words.labels), N_LABELS))
    one[known, words.labels[known]] = 1
    kinds = one @ np.eye(1 + len(KINDS))[KIND_OF]
    pooled = np.zeros((n_groups, kinds.shape[1]))
    np.add.at(pooled, group, kinds[member])
    # What kind the other words of a group are, as a share; summed over a word's groups.
    others = pooled[group] - kinds[member]
    share = np.zeros_like(kinds)
    np.add.at(share, member, others / np.maximum(others.sum(1, keepdims=True), 1))
    after_known = np.flatnonzero((words.linked == 1) & known & np.roll(known, 1))
    weights = [unary, chain, skip]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    rows = np.flatnonzero(known)
    for turn in range(1, rounds + 1 if len(rows) else 1):
        score = unary[words.features].sum(1) + share[:, KIND_OF] * skip[KIND_OF]
        score[words.linked == 0, 2::2] -= CERTAIN
        before = one[after_known - 1]
        score[after_known] += before @ chain
        np.add.at(score, after_known - 1, one[after_known] @ chain.T)
        error = one - np.exp(_normal(score))
        error[~known] = 0
        steep = np.zeros_like(unary)
        for f in range(N_FEATURES):
            for label in range(N_LABELS):
                steep[:, label] += np.bincount(words.features[:, f], error[:, label], BUCKETS)
        steps = [
            steep,
            before.T @ error[after_known] + error[after_known - 1].T @ one[after_known],
            np.bincount(KIND_OF, (error * share[:, KIND_OF]).sum(0), 1 + len(KINDS)),
        ]
        for w, g, (m, v) in zip(weights, steps, moments, strict=True):
            g = g / len(rows) - decay * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(unary.astype(np.float32), chain, np.maximum(skip, 0))


def added_spans(words: Words, log_p: np.ndarray, texts_end: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) per text of the words that got a kind and are in no base span.

    ``texts_end``: where each text's words end. Words of one entity are joined.
    """
    best = log_p.argmax(1)
    spans, start = [], 0
    for stop in texts_end.tolist():
        own: list[tuple[int, int, int]] = []
        joined = False
        for i in range(start, stop):
            kind, free = int(KIND_OF[best[i]]), words.labels[i] <= 0
            if kind and free:
                inside = best[i] % 2 == 0 and joined and words.linked[i] and own[-1][0] == kind - 1
                a, b = words.places[i].tolist()
                if inside:
                    own[-1] = (kind - 1, own[-1][1], b)
                else:
                    own.append((kind - 1, a, b))
            joined = bool(kind and free)
        spans.append(own)
        start = stop
    return spans


_SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())
]))
_PARTS = {"features": np.int32, "labels": np.int8, "linked": np.int8, "keys": np.int64, "places": np.int64}


def _spans_array(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in rows], kind)


def _words_of_rows(rows: list[dict]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of several rows as one, the row of each, and where each row's words end."""
    sizes = np.array([len(row["labels"]) for row in rows], np.int64)
    width = {"features": (-1, N_FEATURES), "keys": (-1, N_KEYS), "places": (-1, 2)}
    parts = {
        name: np.frombuffer(b"".join(row[name] for row in rows), kind).reshape(width.get(name, -1))
        for name, kind in _PARTS.items()
    }
    return Words(**parts), np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes)


def scan_words(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, base spans, and the words that may be part of an entity, of each row."""
    chosen = docs.select("doc_id", *keep, whole("text").alias("scanned"))
    schema = T.StructType([
        *chosen.schema.fields[:-1],
        T.StructField("base", _SPANS),
        *[T.StructField(name, T.BinaryType()) for name in _PARTS],
    ])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, blobs = [], {name: [] for name in _PARTS}
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py()
                good, failed = matches(text)
                words = words_in(text, good, failed)
                base.append(good)
                for name, kind in _PARTS.items():
                    blobs[name].append(getattr(words, name).astype(kind).tobytes())
            columns = [_spans_array(base), *[pa.array(blobs[name], pa.binary()) for name in _PARTS]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    return chosen.mapInArrow(scanned, schema)


def fit_field(scanned: DataFrame, *, max_words: int = MAX_WORDS, max_text_words: int = MAX_TEXT_WORDS) -> Field:
    """Weights learned from about ``max_words`` words of ``scan_words``, or all if there are fewer."""
    usable = scanned.where((F.octet_length("labels") > 0) & (F.octet_length("labels") <= max_text_words))
    total = usable.agg(F.coalesce(F.sum(F.octet_length("labels")), F.lit(0)).alias("n")).first()["n"]
    if total > max_words:
        share = int(max_words / total * (1 << 30))
        usable = usable.where(F.pmod(F.xxhash64("doc_id", "features", "keys"), F.lit(1 << 30)) < share)
    rows = [row.asDict() for row in usable.select("doc_id", *_PARTS).limit(2 * max_words).collect()]
    # The order of the rows changes sums in their last digits.
    rows.sort(key=lambda row: (str(row["doc_id"]), bytes(row["features"]), bytes(row["places"])))
    words, text_of, _ = _words_of_rows(rows)
    return learn(words, text_of)


def label_words(scanned: DataFrame, field: Field, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, base and the spans that the field adds, ``added``, of each row of ``scan_words``."""
    shared = scanned.sparkSession.sparkContext.broadcast(field)
    chosen = scanned.select("doc_id", *keep, "base", *_PARTS)
    schema = T.StructType([
        *chosen.schema.fields[: -len(_PARTS)], T.StructField("added", _SPANS)
    ])

    def labelled(rows: list[dict]) -> list[list[tuple[int, int, int]]]:
        words, text_of, ends = _words_of_rows(rows)
        return added_spans(words, shared.value.marginals(words, text_of), ends)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(_PARTS)
            blobs = [batch.column(i) for i in range(batch.num_columns - len(names), batch.num_columns)]
            added, block, size = [], [], 0
            for values in zip(*blobs, strict=True):
                block.append({name: value.as_py() for name, value in zip(names, values, strict=True)})
                size += len(block[-1]["labels"])
                if size >= BLOCK_WORDS:
                    added += labelled(block)
                    block, size = [], 0
            added += labelled(block) if block else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(names)], _spans_array(added)], schema.names)

    return chosen.mapInArrow(answered, schema)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    ), ",")


def find_personal_data(docs: DataFrame, *, keep: Sequence[str] = (), max_words: int = MAX_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its base spans and those that the field adds.

    Spans are (kind, start, end) in code points, end exclusive, by kind, then start; added spans
    overlap no base span. Null and empty texts, and those without a digit or ``@``, have none.
    Repeated rows get equal rows, null ids stay, further columns are left out unless ``keep`` names
    them (none may be called base, added or like a column of the result). An empty table gives an
    empty result; without any base span the weights add nothing. Between labels of equal
    probability the first counts, outside before all kinds.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; and base, added (arrays).
    """
    scanned = written(scan_words(docs, keep))
    found = label_words(scanned, fit_field(scanned, max_words=max_words), keep)

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *keep,
        *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), "base", "added",
    )
