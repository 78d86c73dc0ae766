"""Merkle manifest: a content-addressed tree over the rows of a table, and proofs out of it.

Every row is a leaf, hashed from its fields. Leaves of a group (a lang) are ranked by doc_id; runs
of eight consecutive nodes become one, until a single node is left. The nodes of all groups, in
the order of the groups, become the root in the same way. Each inner node is stored as a record
from its digest to the digests of its children, once for equal content.

A proof descends from the root: requests hold the node they have reached, look its record up by
digest, go on with the child that the next digit (base eight) of their rank names, and collect the
other children. Requests that share their first digits descend together, so a level has at most as
many rows as the tree has nodes there. Reversed, the collected segments lead from leaf to root.

Ranks come from a range partitioning and the row counts before each partition, so no group is
gathered in one task. Shuffled are digests, never texts. Levels are written tables: a lost executor
costs no more than the tasks it ran. Everything is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.storage import written

BITS = 3  # a run has up to 2 ** BITS nodes
ARITY = 1 << BITS
DIGEST = 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@dataclass(frozen=True)
class Manifest:
    """leaves: place (of the group), rank, and the columns of the leaf table.
    records: per tree and height a table (digest, children), children being their joined digests.
    groups: place, the group's column, n. roots: place, height, digest of each group's subroot.
    top: digest of the root, no row for an empty table; root: the same, hexadecimal, or None."""

    leaves: DataFrame
    groups: DataFrame
    roots: DataFrame
    group_records: list[DataFrame]
    top_records: list[DataFrame]
    top: DataFrame
    root: str | None


def _empty() -> Column:
    return F.lit("").cast("binary")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 length, a colon and its text, or ``-`` for null."""
    texts = [field.cast("string") for field in fields]
    return _hash(F.concat(*[
        F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts
    ]))


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows sorted over all partitions, with ``part`` and ``spot``, their place in it."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(spread.withColumn("spot", F.monotonically_increasing_id()))
    return dealt.withColumn("part", F.shiftright("spot", 33))


def _before(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``before``: rows in earlier partitions. One row per partition, of each group."""
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _ranked(df: DataFrame, order: str) -> DataFrame:
    """Adds ``place``, the rank of each row in the whole table; values of ``order`` are distinct."""
    dealt = _dealt(df, [order])
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("spot").alias("first"))
    starts = _before(counts, []).select("part", "first", "before")
    return dealt.join(starts, "part").select(
        (F.col("spot") - F.col("first") + F.col("before")).alias("place"), *df.columns
    )


def _grow(nodes: DataFrame, top: int) -> tuple[list[DataFrame], DataFrame]:
    """Records per height, and (tree, height, digest) of the last node of each tree.

    ``nodes`` has tree, rank, digest and the number n of nodes in the tree. ``top`` is the largest n.
    """
    records, height = [], 0
    roots = [nodes.where("n = 1").select("tree", F.lit(0).alias("height"), "digest")]
    while top > 1:
        runs = (
            nodes.where("n > 1")
            .groupBy("tree", F.shiftright("rank", BITS).alias("rank"), F.shiftright(F.col("n") + (ARITY - 1), BITS).alias("n"))
            .agg(F.array_sort(F.collect_list(F.struct((F.col("rank") % ARITY).alias("digit"), "digest"))).alias("run"))
            .withColumn("children", F.aggregate("run", _empty(), lambda held, x: F.concat(held, x["digest"])))
        )
        nodes = written(runs.select("tree", "rank", "n", "children", _hash(_hex(F.col("children"))).alias("digest")))
        records.append(written(nodes.select("digest", "children").dropDuplicates(["digest"])))
        height, top = height + 1, -(-top // ARITY)
        roots.append(nodes.where("n = 1").select("tree", F.lit(height).alias("height"), "digest"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return records, written(found)


def build_manifest(leaves: DataFrame, *, group: str = "lang") -> Manifest:
    """The tree over a leaf table with doc_id, ``group``, leaf (a digest) and any further columns.

    Leaves ascend by doc_id, null first, rows that repeat an id by their digest, so the tree does not
    depend on the layout of the table. Nulls are a group of their own, which comes first. Further
    columns are kept in ``leaves`` of the result; they may not be called place, rank or row.
    """
    order = [group, "doc_id", "leaf", "row"]
    dealt = _dealt(written(leaves.withColumn("row", F.monotonically_increasing_id())), order)
    counts = written(dealt.groupBy("part", F.col(group).alias("label")).agg(
        F.count("*").alias("n"), F.min("spot").alias("first")
    ))
    groups = written(_ranked(counts.groupBy("label").agg(F.sum("n").alias("n")), "label"))
    starts = written(
        _before(counts, ["label"]).alias("c")
        .join(groups.alias("g"), F.col("c.label").eqNullSafe(F.col("g.label")))
        .select("part", F.col("g.label").alias("label"), "first", "before", "place", F.col("g.n").alias("size"))
    )
    ranked = dealt.alias("d").join(
        starts.alias("s"), (F.col("d.part") == F.col("s.part")) & F.col(f"d.{group}").eqNullSafe(F.col("s.label"))
    )
    ranked = written(ranked.select(
        "place", (F.col("spot") - F.col("first") + F.col("before")).alias("rank"), "size",
        *[F.col(f"d.{name}") for name in leaves.columns],
    ))
    widest = groups.agg(F.max("n").alias("n"), F.count("*").alias("groups")).first()
    nodes = ranked.select(F.col("place").alias("tree"), "rank", F.col("size").alias("n"), F.col("leaf").alias("digest"))
    group_records, roots = _grow(nodes, widest["n"] or 0)
    tops = roots.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"),
        F.lit(widest["groups"]).cast("bigint").alias("n"), "digest",
    )
    top_records, top = _grow(tops, widest["groups"])
    root = top.select(_hex(F.col("digest")).alias("root")).first()
    return Manifest(
        ranked.drop("size"), groups.withColumnRenamed("label", group), roots.withColumnRenamed("tree", "place"),
        group_records, top_records, top.select("digest"), root["root"] if root else None,
    )


def _segment(children: Column, digit: Column) -> Column:
    at = (digit * DIGEST).cast("int")
    return F.struct(
        F.substring(children, F.lit(1), at).alias("left"),
        F.substring(children, at + (DIGEST + 1), F.octet_length(children)).alias("right"),
    )


def _child(children: Column, digit: Column) -> Column:
    return F.substring(children, (digit * DIGEST).cast("int") + 1, F.lit(DIGEST))


def _descend(reached: DataFrame, records: DataFrame) -> DataFrame:
    """One step down for rows (tree, rank, digest, path): a row per child, the others collected."""
    digits = F.sequence(F.lit(0), (F.octet_length("children") / DIGEST).cast("int") - 1)
    opened = reached.join(records, "digest").withColumn("digit", F.explode(digits))
    return opened.select(
        "tree", (F.col("rank") * ARITY + F.col("digit")).alias("rank"),
        _child(F.col("children"), F.col("digit")).alias("digest"),
        F.array_append("path", _segment(F.col("children"), F.col("digit"))).alias("path"),
    )


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Adds ``subroot``, ``reached`` and ``path`` to rows of ``manifest.leaves``, all by default.

    ``reached`` is the digest that the descent found at the row's place. ``path`` leads from leaf to
    root: per level the joined digests to the left and to the right of the node, both possibly empty.
    """
    whole = requests is None
    requests = manifest.leaves if whole else requests

    def wanted(rows: DataFrame, place: Column, rank: Column) -> DataFrame:
        """Only nodes that some request goes through."""
        if whole:
            return rows
        asked = requests.select(place.alias("tree"), rank.alias("rank")).distinct()
        return rows.join(asked, ["tree", "rank"], "left_semi")

    none = F.lit(0).cast("bigint")
    steps = len(manifest.top_records)
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    reached = manifest.top.select(none.alias("tree"), none.alias("rank"), "digest", nothing.alias("path"))
    for height in range(steps, 0, -1):
        lower = F.shiftright("place", BITS * (height - 1))
        reached = wanted(_descend(reached, manifest.top_records[height - 1]), none, lower)

    # Each group begins its own descent at the height of its subroot.
    heads = reached.select(F.col("rank").alias("place"), "digest", "path").join(
        manifest.roots.select("place", "height"), "place"
    )
    heads = written(heads.select(F.col("place").alias("tree"), none.alias("rank"), "digest", "path", "height"))
    reached = None
    for height in range(len(manifest.group_records), 0, -1):
        begun = heads.where(F.col("height") == height).drop("height")
        reached = begun if reached is None else reached.unionByName(begun)
        if height > 1:
            lower = F.shiftright("rank", BITS * (height - 1))
            reached = wanted(_descend(reached, manifest.group_records[height - 1]), F.col("place"), lower)

    # The last step is taken by runs of leaves, so that a path moves once for all eight.
    last = heads.where("height = 0").select("tree", "rank", F.lit(None).cast("binary").alias("children"), "digest", "path")
    if reached is not None:
        opened = reached.join(manifest.group_records[0], "digest")
        last = last.unionByName(opened.select("tree", "rank", "children", "digest", "path"))
    others = [name for name in requests.columns if name not in ("place", "rank")]
    runs = requests.groupBy(F.col("place").alias("tree"), F.shiftright("rank", BITS).alias("run")).agg(
        F.collect_list(F.struct("rank", *others)).alias("rows")
    )
    met = runs.join(last.withColumnRenamed("rank", "run"), ["tree", "run"]).withColumn("row", F.explode("rows"))
    digit, single = F.col("row.rank") % ARITY, F.col("children").isNull()
    proven = met.select(
        F.col("tree").alias("place"),
        F.when(single, F.col("digest")).otherwise(_child(F.col("children"), digit)).alias("reached"),
        F.reverse(
            F.when(single, F.col("path")).otherwise(F.array_append("path", _segment(F.col("children"), digit)))
        ).alias("path"),
        *[F.col(f"row.{name}").alias(name) for name in ["rank", *others]],
    )
    subroots = manifest.roots.select("place", F.col("digest").alias("subroot"))
    return proven.join(subroots, "place")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the path of a proof lead to."""
    return F.aggregate(path, leaf, lambda node, s: _hash(_hex(F.concat(s["left"], node, s["right"]))))


def siblings(path: Column) -> Column:
    """All siblings of a proof from leaf to root, joined."""
    return F.aggregate(path, _empty(), lambda held, s: F.concat(held, s["left"], s["right"]))


def lowered(text: Column) -> Column:
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, upper, upper.lower())


def verify_rows(docs: DataFrame, tampered: Column) -> DataFrame:
    """Proofs of all rows, checked against rows some of which were tampered with.

    Rows for which ``tampered`` holds are checked with their text lower-cased (A-Z). One result row
    per row of ``docs``; rows that repeat an id each have their own leaf and proof. Null fields are
    hashed as ``-``, null langs are one group. A table of one row is its own root, and its proof is
    empty; an empty table gives an empty result. Further columns of ``docs`` are left out.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; and lang and rank,
    the place of the leaf, and reached, whether the descent ended at the leaf.
    """
    whole = [F.col(name) for name in FIELDS]
    bent = [lowered(F.col(name)) if name == "text" else F.col(name) for name in FIELDS]
    leaf = leaf_of(whole)
    leaves = docs.select(
        "doc_id", "lang", leaf.alias("leaf"), F.when(tampered, leaf_of(bent)).alias("claimed")
    )
    manifest = build_manifest(leaves)
    proven = prove(manifest).withColumn("folded", fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return proven.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(_hex(siblings(F.col("path"))), 256).alias("proof_sha256"),
        _hex(F.col("folded")).alias("folded_root"),
        (_hex(F.col("folded")) == F.lit(manifest.root).cast("string")).alias("verified"),
        "lang", "rank", (F.col("reached") == F.col("leaf")).alias("reached"),
    )


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: the plain loop over bytes and bits; the number is CRC-32's fixed polynomial."""
    byte = "xor(c, b)"
    bits = "list_reduce(list_prepend({byte}, range(8)::BIGINT[]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ord(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits.format(byte=byte)}), 4294967295)"


def sql() -> str:
    """The same rows in DuckDB: trees by recursion upwards, then every leaf folded upwards."""

    def leaf(text: str) -> str:
        fields = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}, '-')" for f in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    folded = "sha256(coalesce(string_agg(x.digest, '' ORDER BY x.rank) FILTER (x.rank < f.rank), '') || any_value(f.folded) || " \
        "coalesce(string_agg(x.digest, '' ORDER BY x.rank) FILTER (x.rank > f.rank), ''))"
    others = "coalesce(string_agg(x.digest, '' ORDER BY x.rank) FILTER (x.rank != f.rank), '')"

    def climbed(name: str, start: str, tree: str) -> str:
        return f"""{name} AS (
    {start}
    UNION ALL
    SELECT f.leaf_id, f.place, f.level + 1, f.rank // 8, {folded}, any_value(f.proof) || {others}
    FROM {name} f JOIN {tree} x ON x.place = f.place AND x.level = f.level AND x.rank // 8 = f.rank // 8
    WHERE x.n > 1
    GROUP BY f.leaf_id, f.place, f.level, f.rank
)"""

    def tree(name: str, start: str) -> str:
        return f"""{name} AS (
    {start}
    UNION ALL
    SELECT place, level + 1, rank // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY rank))
    FROM {name} WHERE n > 1 GROUP BY place, level, rank // 8, n
)"""

    return f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, lang, {leaf('text')} AS leaf,
        CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")}
            ELSE {leaf('text')} END AS claimed
    FROM documents
),
leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS place,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
        count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (ORDER BY lang, doc_id, leaf) AS leaf_id
    FROM hashed
),
{tree('nodes', "SELECT place, 0 AS level, rank, n, leaf AS digest FROM leaves")},
subroots AS (SELECT place, digest AS subroot FROM nodes WHERE n = 1),
{tree('tops', "SELECT 0::BIGINT AS place, 0 AS level, place AS rank, (SELECT count(*) FROM subroots) AS n, subroot AS digest FROM subroots")},
{climbed('inner_path', "SELECT leaf_id, place, 0 AS level, rank, claimed AS folded, '' AS proof FROM leaves", 'nodes')},
headed AS (SELECT leaf_id, max_by(folded, level) AS folded, max_by(proof, level) AS proof, any_value(place) AS rank FROM inner_path GROUP BY leaf_id),
{climbed('outer_path', "SELECT leaf_id, 0::BIGINT AS place, 0 AS level, rank, folded, proof FROM headed", 'tops')},
ended AS (SELECT leaf_id, max_by(folded, level) AS folded, max_by(proof, level) AS proof FROM outer_path GROUP BY leaf_id)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
    folded AS folded_root, folded = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM leaves JOIN subroots USING (place) JOIN ended USING (leaf_id)
"""
