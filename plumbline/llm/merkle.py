"""Merkle dataset manifest over concatenated levels.

Every row is a leaf.  The leaves of one tree are cut into aligned blocks of
``fanout ** depth``; a block keeps each of its levels as one hex string, 64 signs
a node.  Parents are hashes of fixed-width substrings of the level below, and the
siblings of a node are the substrings that flank it in its run, so nothing inside
a block is ever sorted, joined or exploded by node.  Block roots are the leaves of
the next tier, until a tree has one node; the trees' roots, in order, are one more
tree.  Proofs go back down: a block hands each member its own segments followed by
those above it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(value: Column) -> Column:
    """A string that sorts like ``value`` bytewise, with null first and apart from all values."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def with_positions(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` plus ``pos``, the place within the ``tree`` by ``order``, and ``size``, the tree's rows.

    A range sort deals all rows evenly, one tree over many partitions; the counts
    of the partitions before give each its first place.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = scratch.put(sorted_rows.select("*", F.spark_partition_id().alias("part"), within.alias("at")), name)
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    placed = dealt.join(starts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    return placed.select(*rows.columns, "pos", "size")


@dataclass
class Manifest:
    """Tiers of blocks from the leaves up, then those of the trees' roots.

    A block is ``(tree, block, size, members, l0 .. ldepth)``: ``members`` in order,
    ``l0`` their nodes and ``ldepth`` the block's root.
    """

    tiers: list[DataFrame]
    roots: list[DataFrame]
    fanout: int
    depth: int

    @property
    def span(self) -> int:
        return self.fanout**self.depth


def _climbs(level: int, span: int) -> Column:
    """Whether the nodes of a block's level are hashed: the tree has more than one node there."""
    return (F.col("size") > span) | (F.length(f"l{level}") > _HEX)


def _parents(level: Column, run: int) -> Column:
    """The level above: a hash of every ``run`` signs, the last run may have fewer."""
    last = F.ceil(F.length(level) / run).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.substring(level, i * run + 1, F.lit(run)))), "")


def _blocks(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Blocks of ``(tree, pos, size, node, ...)``; further columns become fields of the members."""
    span, run = fanout**depth, fanout * _HEX
    member = F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "pos", "size")])
    block = F.floor(F.col("pos") / span).cast("long").alias("block")
    out = nodes.groupBy("tree", block, "size").agg(F.sort_array(F.collect_list(member)).alias("members"))
    out = out.withColumn("l0", F.array_join("members.node", ""))
    for j in range(depth):
        level = F.col(f"l{j}")
        out = out.withColumn(f"l{j + 1}", F.when(_climbs(j, span), _parents(level, run)).otherwise(level))
    return out


def _tiers(nodes: DataFrame, scratch: Scratch, name: str, fanout: int, depth: int) -> list[DataFrame]:
    """Tiers of blocks over ``nodes`` until every tree has one node."""
    span, tiers = fanout**depth, []
    while True:
        tiers.append(scratch.put(_blocks(nodes, fanout, depth), f"{name}-{len(tiers)}"))
        more = tiers[-1].where(F.col("size") > span)
        if more.isEmpty():
            return tiers
        size = F.ceil(F.col("size") / span).cast("long")
        nodes = more.select("tree", F.col("block").alias("pos"), size.alias("size"), F.col(f"l{depth}").alias("node"))


def _tops(tier: DataFrame, span: int, depth: int) -> DataFrame:
    """``(tree, node)`` of the trees that end in this tier."""
    return tier.where(F.col("size") <= span).select("tree", F.col(f"l{depth}").alias("node"))


def build(leaves: DataFrame, order: list[str], fanout: int = 8, depth: int = 3) -> Manifest:
    """The manifest of ``leaves (tree, node, ...)``, each tree in ``order``.

    ``fanout ** depth`` leaves make a block: its strings are that times 64 bytes.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    tiers = _tiers(with_positions(leaves, order, scratch, "leaves"), scratch, "tier", fanout, depth)
    tops = _tops(tiers[0], fanout**depth, depth)
    for tier in tiers[1:]:
        tops = tops.unionByName(_tops(tier, fanout**depth, depth))
    tops = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    return Manifest(tiers, _tiers(with_positions(tops, ["name"], scratch, "tops"), scratch, "top", fanout, depth), fanout, depth)


def _segments(i: Column, manifest: Manifest) -> Column:
    """What flanks member ``i`` of a block, level by level, as ``array<struct<left, right>>``."""
    run, found = manifest.fanout * _HEX, []
    for j in range(manifest.depth):
        at = F.floor(i / manifest.fanout**j).cast("int")
        start = F.floor(at / manifest.fanout).cast("int") * run
        left = F.substring(F.col(f"l{j}"), start + 1, at * _HEX - start)
        right = F.substring(F.col(f"l{j}"), (at + 1) * _HEX + 1, start + run - (at + 1) * _HEX)
        found.append(F.when(_climbs(j, manifest.span), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def _descend(tiers: list[DataFrame], above: DataFrame, manifest: Manifest, what) -> DataFrame:
    """``what(member, segments, above)`` of all members of the lowest tier.

    ``above (tree, path, top, ...)`` says what lies over each tree's root.  Every
    tier's members become what lies over the blocks of the tier below.
    """
    fields = [c for c in above.columns if c != "tree"]
    over = None
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        ends = tier.where(F.col("size") <= manifest.span).join(above, "tree")
        blocks = ends if over is None else ends.unionByName(tier.where(F.col("size") > manifest.span).join(over, ["tree", "block"]))
        if not k:
            made = F.transform("members", lambda m, i: what(m, F.concat(_segments(i, manifest), F.col("path"))))
            return blocks.select("tree", F.explode(made).alias("made"), *[c for c in fields if c != "path"])
        made = F.transform("members", lambda m, i: F.struct(m["pos"].alias("pos"), F.concat(_segments(i, manifest), F.col("path")).alias("path")))
        over = blocks.select("tree", F.explode(made).alias("made"), *[c for c in fields if c != "path"])
        over = over.select("tree", F.col("made.pos").alias("block"), F.col("made.path").alias("path"), *[c for c in fields if c != "path"])


def refold(node: Column, path: Column) -> Column:
    """The root that ``node`` gives with the siblings of ``path``."""
    return F.aggregate(path, node, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings on the path, from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def prove(manifest: Manifest, keep: list[str], claim: str) -> DataFrame:
    """Fold every leaf's ``claim`` (a node to test in its place) with its siblings up to the root.

    Returns the member fields ``keep``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root`` and ``verified``.
    """
    last = manifest.roots[-1].select(F.col(f"l{manifest.depth}").alias("root"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = last.select(F.lit("").alias("tree"), "root", none.alias("path"))
    trees = _descend(manifest.roots, start, manifest, lambda m, path: F.struct(m["name"].alias("name"), m["node"].alias("node"), path.alias("path")))
    above = trees.select(F.col("made.name").alias("tree"), F.col("made.path").alias("path"), F.col("made.node").alias("subroot"), "root")
    out = _descend(
        manifest.tiers, above, manifest,
        lambda m, path: F.struct(*[m[c].alias(c) for c in keep], m["node"].alias("leaf"), proof_digest(path).alias("proof_sha256"), refold(m[claim], path).alias("folded_root")),
    )
    out = out.select("made.*", "subroot", "root")
    return out.select(*keep, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def document_leaves(documents: DataFrame, altered: Column) -> DataFrame:
    """``(tree, doc_id, node, claim)``: the leaf of each document, and that of its text as ``altered``."""
    head = [framed(F.col(c)) for c in FIELDS[:-1]]
    node, changed = digest(*head, framed(F.col("text"))), digest(*head, framed(altered))
    same = altered.eqNullSafe(F.col("text"))
    return documents.select(tree_key(F.col("lang")).alias("tree"), "doc_id", node.alias("node"), F.when(~same, changed).alias("other")).withColumn("claim", F.coalesce("other", "node")).drop("other")


def verify_documents(documents: DataFrame, altered: Column | None = None, fanout: int = 8, depth: int = 3) -> DataFrame:
    """Manifest of ``documents``, a tree a language, and whether each document's text as ``altered`` still proves.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of
    every row.  ``altered`` defaults to the text itself.

    Nulls in any column are framed as ``-``; a null language is a tree of its own,
    before all others, and a null doc_id stands first in its tree.  Rows of equal
    doc_id stand by their leaves; equal rows are leaves each.  Empty and very long
    texts are hashed whole.  A tree of one leaf has it as root.  An empty table
    gives no rows.  Columns beside the five framed ones have no part in it.
    """
    altered = F.col("text") if altered is None else altered
    manifest = build(document_leaves(documents, altered), ["doc_id", "node"], fanout, depth)
    return prove(manifest, ["doc_id"], "claim")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dealt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verify_documents(documents, F.when(dealt, F.translate("text", _UPPER, _ASCII_LOWER)).otherwise(F.col("text")))


def _framed_sql(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in columns)


def _tree_sql(prefix: str, leaves: str, levels: int) -> str:
    """WITH entries that climb from ``leaves (tree, id, pos, node, claim)`` up, run by run, to ``{prefix}top (tree, node)`` and ``{prefix}path (tree, id, node, folded, sides)``."""
    out = [f"{prefix}f0 AS (SELECT tree, id, pos, node, claim AS folded, '' AS sides FROM {leaves})", f"{prefix}n0 AS (SELECT tree, pos, node FROM {leaves})"]
    for j in range(levels):
        out += [
            f"{prefix}r{j} AS (SELECT tree, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM {prefix}n{j} WHERE tree IN (SELECT tree FROM {prefix}n{j} GROUP BY tree HAVING count(*) > 1) GROUP BY tree, pos // 8)",
            f"{prefix}n{j + 1} AS (SELECT tree, run AS pos, sha256(array_to_string(nodes, '')) AS node FROM {prefix}r{j} UNION ALL SELECT tree, pos, node FROM {prefix}n{j} WHERE tree NOT IN (SELECT tree FROM {prefix}r{j}))",
            f"{prefix}s{j} AS (SELECT f.*, coalesce(array_to_string(nodes[1:f.pos % 8], ''), '') AS a, coalesce(array_to_string(nodes[f.pos % 8 + 2:], ''), '') AS b, nodes IS NOT NULL AS up FROM {prefix}f{j} f LEFT JOIN {prefix}r{j} r ON f.tree = r.tree AND f.pos // 8 = r.run)",
            f"{prefix}f{j + 1} AS (SELECT tree, id, CASE WHEN up THEN pos // 8 ELSE pos END AS pos, node, CASE WHEN up THEN sha256(a || folded || b) ELSE folded END AS folded, sides || a || b AS sides FROM {prefix}s{j})",
        ]
    return ", ".join([*out, f"{prefix}top AS (SELECT tree, node FROM {prefix}n{levels})", f"{prefix}path AS (SELECT tree, id, node, folded, sides FROM {prefix}f{levels})"])


_LOWER_SQL = f"translate(text, '{_UPPER}', '{_ASCII_LOWER}')"
#: CRC-32 of a decimal: a byte is eight steps of the reflected polynomial.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT)"""

#: Eight levels hold 16 million documents of a language.
OP13_SQL = f"""
WITH t AS (SELECT *, CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_LOWER_SQL} ELSE text END AS altered FROM documents),
h AS (SELECT doc_id, lang, sha256({_framed_sql("doc_id", "source", "lang", "n_chars", "text")}) AS node,
             sha256({_framed_sql("doc_id", "source", "lang", "n_chars", "altered")}) AS claim FROM t),
leaves AS (SELECT coalesce('1' || lang, '0') AS tree, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, node, claim FROM h),
{_tree_sql("d", "leaves", 8)},
tops AS (SELECT '' AS tree, tree AS id, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, node, node AS claim FROM dtop),
{_tree_sql("t", "tops", 8)},
whole AS (SELECT d.id AS doc_id, d.node AS leaf, p.node AS subroot, d.folded AS low, d.sides || p.sides AS sides, p.id AS tree FROM dpath d JOIN tpath p ON d.tree = p.id),
up0 AS (SELECT w.*, w.low AS folded, t.pos FROM whole w JOIN tops t ON t.id = w.tree),
{{up}}
SELECT doc_id, leaf, subroot, (SELECT node FROM ttop) AS root, sha256(sides) AS proof_sha256, folded AS folded_root, folded = (SELECT node FROM ttop) AS verified FROM up8
""".replace("{up}", ", ".join(
    f"up{j + 1} AS (SELECT u.* REPLACE (CASE WHEN nodes IS NULL THEN folded ELSE sha256(coalesce(array_to_string(nodes[1:u.pos % 8], ''), '') || folded || coalesce(array_to_string(nodes[u.pos % 8 + 2:], ''), '')) END AS folded, CASE WHEN nodes IS NULL THEN u.pos ELSE u.pos // 8 END AS pos) "
    f"FROM up{j} u LEFT JOIN tr{j} r ON u.pos // 8 = r.run)"
    for j in range(8)
))
