"""Secret scans: patterns per text, and how many owners hold each candidate in the whole corpus.

Base spans come from three patterns and depend on the text alone. The method adds spans: a wider
pattern proposes tokens, every candidate value is hashed and counted by distinct repositories and
owners, and a token that few of both hold is taken for a live credential of theirs. A value that
many owners or repositories hold is a copied example; its tokens are not added.

Everything is DataFrame code. Texts are scanned once; what is shuffled and written is one thin row
per document and the hashes of its candidates. Counts are combined before they are shuffled, and a
value held by a third of all rows is reduced to one row per owner and task on the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions.text import let
from postsift.storage import written

from .common import whole


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns, written so that two regular expression engines agree on case.
NAMES = "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"]))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGN = 12
# A maximal run that is too short can't match, so the least length can be part of these patterns.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "owned"]

# The method's own candidates: long tokens with a letter and a digit.
TOKEN = "[A-Za-z0-9_-]{20,}"
# A value that more owners or repositories hold is a copied example.
MAX_OWNERS = 2
MAX_REPOSITORIES = 4
# Signs that are passed by to find the places of a text, beyond which its signs are listed first.
MANY_PLACES = 20_000_000

_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def running(values: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Running results of ``step`` (a sum, a maximum) over an array of bigint, itself included.

    Appending copies what is there, so it is done block by block, and then once over the blocks.
    """

    def appended(part: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(part, none, lambda held, x: F.concat(
            held, F.array(F.when(F.size(held) > 0, step(F.element_at(held, -1), x)).otherwise(x))
        ))

    def joined(parts: Column) -> Column:
        return let(
            appended(F.transform(parts, lambda part: F.element_at(part, -1))),
            lambda before: F.flatten(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(
                F.transform(part, lambda x: step(F.get(before, i - 1), x))
            ))),
        )

    def blocks(listed: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(listed), F.lit(1)), F.lit(block))
        return F.transform(firsts, lambda first: appended(F.slice(listed, first, F.lit(block))))

    return F.when(F.size(values) > 0, let(values, lambda listed: let(blocks(listed), joined))).otherwise(
        F.array().cast("array<bigint>")
    )


def _with_spans(df: DataFrame, name: str, pattern: str, kind: int, group: int = 0) -> DataFrame:
    """Adds leftmost non-overlapping matches as (start, kind, end, value), in code points.

    A match ends where the texts between matches and the matches so far end.
    """
    df = df.withColumn("found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn(
        "value", F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else F.col("found")
    ).withColumn("between", F.when(F.size("found") > 0, F.split("text", pattern)))
    sizes = F.transform(
        "found", lambda x, i: (F.length(x) + F.length(F.get("between", i))).cast("bigint")
    )
    df = df.withColumn("ends", F.when(F.size("found") > 0, running(sizes, lambda a, x: a + x)))
    spans = F.transform(
        F.arrays_zip("found", "value", "ends"),
        lambda x: F.struct(
            (x["ends"] - F.length(x["found"])).alias("start"), F.lit(kind).alias("kind"),
            x["ends"].alias("end"), x["value"].alias("value"),
        ),
    )
    df = df.withColumn(name, F.when(F.size("found") > 0, spans).otherwise(F.array()).cast(_SPANS))
    return df.drop("found", "value", "between", "ends")


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(
        F.sort_array(spans),
        lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    ), ",")


def base_spans(texts: DataFrame) -> DataFrame:
    """Adds ``base`` and ``tokens`` to rows with a text without nulls."""
    df = _with_spans(texts, "a", ASSIGN, 0, group=2)
    df = _with_spans(df.withColumn("a", F.filter("a", lambda s: F.length(s["value"]) >= MIN_ASSIGN)), "b", ACCESS, 1)
    df = _with_spans(_with_spans(df, "c", HEX, 2), "tokens", TOKEN, 3)
    df = df.withColumn("base", F.sort_array(F.concat("a", "b", "c"))).drop("a", "b", "c")
    return df.withColumn(
        "tokens", F.filter("tokens", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    )


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Equal for rows of equal id and text, and only for these; nulls count as empty."""
    return F.md5(F.concat_ws("\n", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), whole(text)).cast("binary"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Owners and repositories per candidate hash, of rows (hash, owner, repository)."""
    held = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan_secrets(
    docs: DataFrame,
    *,
    owner: Column | None = None,
    repository: Column | None = None,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, and what owner and repository need).

    The owner of a document is its ``source`` by default, its repository source and lang. A null
    owner or repository counts as one of its own. Null and empty texts have no spans: counts are 0
    and both span lists empty. Repeated rows give equal rows, null ids stay; further columns are
    left out, whatever their names. An empty table gives an empty result.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans; and n_owned (tokens added),
    n_copied (candidates that more than ``max_owners`` or ``max_repositories`` hold), owned (the added spans), row_key.
    """
    thin = written(base_spans(_scanned(docs, owner, repository)).drop("text"))
    added = _judged(thin, max_owners, max_repositories)
    full = thin.select("doc_id", "row_key", "base").join(added, "row_key", "left")
    full = full.withColumn("owned", F.coalesce("owned", F.array().cast(_SPANS)))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return full.select(
        "doc_id",
        number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "owned")).alias("spans"),
        F.size("owned").cast("bigint").alias("n_owned"),
        F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"),
        "owned", "base", "row_key",
    )


def _scanned(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, **kept: Column) -> DataFrame:
    """What a scan needs of ``docs``, and ``kept``."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("\n", "source", "lang") if repository is None else repository
    return docs.select(
        "doc_id", whole("text").alias("text"), row_key().alias("row_key"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        *[column.alias(name) for name, column in kept.items()],
    )


def _judged(thin: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """(row_key, owned, n_copied) of the rows with candidates: tokens to add, and how many are copied."""
    found = thin.select("row_key", "owner", "repository", F.explode(F.concat("base", "tokens")).alias("span")).select(
        "row_key", "owner", "repository", F.sha2(F.col("span.value").cast("binary"), 256).alias("hash"), "span"
    )
    counted = ownership(found.select("hash", "owner", "repository"))
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    judged = found.join(counted.select("hash", copied.alias("copied")), "hash")
    return judged.groupBy("row_key").agg(
        F.array_sort(F.collect_set(F.when(
            (F.col("span.kind") == 3) & ~F.col("copied"), F.col("span")
        ))).alias("owned"),
        F.count_distinct(F.when(F.col("copied"), F.struct("span.start", "span.kind"))).alias("n_copied"),
    )


def redact(docs: DataFrame, *, mark: str = "[secret]", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark and ``n_chars`` set to match.

    Base spans and added ones are replaced; spans that overlap are replaced together. Rows without
    secrets stay as they are, null texts included. Columns stay the same. Texts are written once
    with what was found in them; only those with a candidate are shuffled.
    """
    # The columns of the documents are kept in one, so that their names clash with none.
    scanned = written(base_spans(_scanned(docs, row=F.struct(*[F.col(f"`{name}`") for name in docs.columns]))).drop("text"))
    candidates = F.size("base") + F.size("tokens") > 0
    added = _judged(scanned, max_owners, MAX_REPOSITORIES).select("row_key", "owned")
    marks = F.sort_array(F.concat("base", F.coalesce("owned", F.array().cast(_SPANS))))
    marked = scanned.where(candidates).join(added, "row_key", "left").withColumn("marks", marks)
    found, text = F.size("marks") > 0, F.col("row").getField("text")
    marked = marked.withColumn(
        "text", F.when(found, let(F.col("marks"), lambda spans: _hidden(text, spans, mark))).otherwise(text)
    )
    kept = {name: F.col("row").getField(name) for name in docs.columns}
    changed = kept | {name: F.col("text") for name in docs.columns if name.lower() == "text"}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found, F.length("text")).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)

    def named(columns: dict[str, Column]) -> list[Column]:
        return [column.alias(name) for name, column in columns.items()]

    return marked.select(*named(changed)).union(scanned.where(~candidates).select(*named(kept)))


def _hidden(text: Column, spans: Column, mark: str) -> Column:
    """A text with spans, sorted by start, replaced; of spans that overlap there is one mark."""

    def pieces(listed: Column, ends: Column, cut: Callable[[Column, Column], Column]) -> Column:
        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1))
            return F.when(span["start"] >= before, F.concat(cut(before, span["start"]), F.lit(mark))).otherwise(F.lit(""))

        rest = cut(F.element_at(ends, -1), F.length(text).cast("bigint"))
        return F.array_join(F.concat(F.transform(listed, piece), F.array(rest)), "")

    def substring(start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    def by_signs(listed: Column, ends: Column) -> Column:
        return let(F.split(text, ""), lambda signs: pieces(listed, ends, lambda start, end: F.array_join(
            F.slice(signs, (start + 1).cast("int"), (end - start).cast("int")), ""
        )))

    def hidden(ends: Column) -> Column:
        # Finding a place takes time in proportion to it; many places are found in a list of signs.
        far = F.size(spans).cast("bigint") * F.length(text) > MANY_PLACES
        return F.when(far, by_signs(spans, ends)).otherwise(pieces(spans, ends, substring))

    return let(running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), hidden)


def sql(max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> str:
    """The same rows in DuckDB."""

    def spans(kind: int, pattern: str, group: int, condition: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
    SELECT doc_id, {kind} AS kind, s.start AS start, s.stop AS stop, s.value AS value FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(found) + 1), lambda i: {{
            'start': list_sum(list_transform(between[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0),
            'stop': list_sum(list_transform(between[1:i], lambda x: length(x)))
                + list_sum(list_transform(found[1:i], lambda x: length(x))),
            'value': value[i]}})) AS s
        FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS found,
            regexp_extract_all(text, '{quoted}', {group}) AS value,
            string_split_regex(text, '{quoted}') AS between FROM docs))
    WHERE {condition}"""

    parts = "\n    UNION ALL".join([
        spans(0, ASSIGN, 2, f"length(value) >= {MIN_ASSIGN}"),
        spans(1, ACCESS, 0, "true"),
        spans(2, HEX, 0, "true"),
        spans(3, TOKEN, 0, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')"),
    ])
    kinds = "[" + ", ".join(f"'{kind}'" for kind in KINDS) + "]"
    text = f"({kinds})[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
        coalesce(source || chr(10) || lang, source, lang, '') AS repository FROM documents
),
spans AS ({parts}
),
counted AS (
    SELECT value, count(DISTINCT owner) > {max_owners} OR count(DISTINCT (owner, repository)) > {max_repositories} AS copied
    FROM spans JOIN docs USING (doc_id) GROUP BY value
),
judged AS (SELECT s.*, copied, {text} AS line FROM spans s JOIN counted USING (value)),
found AS (
    SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
        count(*) FILTER (kind = 2) AS n_hex,
        coalesce(string_agg(line, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base,
        coalesce(string_agg(line, ',' ORDER BY start, kind) FILTER (kind < 3 OR NOT copied), '') AS spans,
        count(*) FILTER (kind = 3 AND NOT copied) AS n_owned,
        count(*) FILTER (copied) AS n_copied
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
