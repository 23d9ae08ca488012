"""Merkle manifest of a data set, and a recursive query that recomputes the root from every leaf.

A leaf is the SHA-256 of a row's columns, each written with its length. The leaves of a run (a language) are ordered by
document id and paired up level by level until one node, the subroot, remains; the subroots are paired up in the same way.
Of the levels that are built one in ``LEVELS`` is stored, as node rows linked to their parent: a row has the siblings of
all levels up to its parent. The proof of a leaf is climbed by a recursive common table expression of Spark: each
round joins the current node to its row, appends the siblings and folds the digest, so the number of rounds is the
height divided by ``LEVELS``. Rows of leaves are joined in the first member of the expression, the rounds read the others only.

Nodes above the leaves are fewer by 2^LEVELS. Their size is measured: they are broadcast to the rounds within a bound, and
shuffled beyond it. Then those near the root, which are reached from very many leaves, get copies, and a leaf joins the
copy that its number names, so no task gets all leaves of a node. Leaves are numbered by range-partitioned running totals,
and runs are joined hot and cold, so a run may hold any share of the rows. No table passes the driver.

Defined results: a null column is written as ``-``; null languages are a run of their own that comes first; null ids come
first in their run and are never tampered with; equal ids are ordered by leaf, so repeated rows are neighbours and
each has its own leaf and proof; a data set of one row has its leaf as root and the digest of nothing as proof;
an empty one has no rows. Very long texts are hashed whole inside one row. Extra columns are not part of the leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codonlake.llm.common import join_hot, register, stored, table
from codonlake.operators.distribute import running_total

#: Columns of a leaf, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels between two stored ones; a group of 2^LEVELS nodes is paired up inside one row.
LEVELS = 10
#: A node's number is that of its first leaf times STEPS, plus the stored levels below it.
STEPS = 128
#: Bytes of inner nodes that a round may broadcast; beyond it, copies of a node with two or more stored levels below it.
BROADCAST_BYTES, COPIES = 64 * 1024 * 1024, 1024


@dataclass(frozen=True)
class Manifest:
    """leaves: g (number), node, run, leaf, columns kept. nodes: node, parent, place, path. runs: run, n, base, subroot."""

    leaves: DataFrame
    nodes: DataFrame
    runs: DataFrame
    root_node: int | None
    root: str | None


def digest(columns: list[Column]) -> Column:
    """SHA-256 as binary of columns written with their UTF-8 length, or ``-`` for null."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*each), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _paired(nodes: Column) -> Column:
    """Hex digests one level up: every two neighbours together, a last one alone."""
    last = F.floor((F.size(nodes) + 1) / 2).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256))


def _step(rows: DataFrame) -> DataFrame:
    """One stored level from the one below: (tree, n, pos, node, digest) to groups with the links of their members."""
    width = 1 << LEVELS
    grouped = rows.where("n > 1").groupBy("tree", "n", F.expr(f"pos div {width}").alias("group")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", "digest"))).alias("kids"))  # width rows at most
    height = F.least(F.lit(LEVELS), F.length(F.bin(F.col("n") - 1)))  # levels that are left in the tree
    levels = F.aggregate(F.sequence(F.lit(1), height), F.array(F.transform("kids", lambda k: hex_text(k["digest"]))),
                         lambda made, _: F.concat(made, F.array(_paired(F.element_at(made, -1)))))
    grouped = grouped.select("tree", "group", "kids", levels.alias("levels"),
                             F.expr(f"(n + {width - 1}) div {width}").alias("n"), (F.element_at("kids", 1)["node"] + 1).alias("parent"))
    sibling = "transform(slice(levels, 1, size(levels) - 1), (level, k) -> unhex(get(level, shiftright(place, k) ^ 1)))"
    members = F.expr(f"transform(kids, (kid, place) -> struct(kid.node AS node, place AS place, {sibling} AS path))")
    return grouped.select("tree", "n", F.col("group").alias("pos"), F.col("parent").alias("node"),
                          F.unhex(F.element_at(F.element_at("levels", -1), 1)).alias("digest"), members.alias("members"))


def _raised(rows: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Pairs up every tree of ``rows`` to its top, adding the stored steps to ``made``. Returns tree, node, digest of the tops."""
    tops = []
    while True:
        tallest = rows.agg(F.max("n")).first()[0] or 0
        tops.append(rows.where("n = 1").select("tree", "node", "digest"))
        if tallest <= 1:
            break
        made.append(stored(_step(rows)))
        rows = made[-1].drop("members")
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def build_manifest(hashed: DataFrame, run: str = "run", order: tuple[str, ...] = ("doc_id", "leaf")) -> Manifest:
    """Manifest of rows with a column ``leaf`` (binary) and a run that is never null and sorts by its bytes."""
    numbered = running_total(hashed.withColumn("_one", F.lit(1).cast("long")), [], [run, *order], "_one", "g")
    leaves = stored(numbered.select("*", ((F.col("g") - 1) * STEPS).alias("node")).drop("_one"))
    runs = stored(leaves.groupBy(run).agg(F.count("*").alias("n"), F.min("g").alias("base")))
    rows = join_hot(leaves.select(run, "g", "node", "leaf"), runs.select(run, "n", F.col("n").alias("_n"), "base"), run, "_n", leaves.count())
    made: list[DataFrame] = []
    tops = stored(_raised(rows.select(F.col("base").alias("tree"), "n", (F.col("g") - F.col("base")).alias("pos"), "node", F.col("leaf").alias("digest")), made))
    ranked = running_total(tops.withColumn("_one", F.lit(1).cast("long")), [], ["tree"], "_one", "rank")
    n_runs = tops.count()
    over = ranked.select(F.lit(0).cast("long").alias("tree"), F.lit(n_runs).cast("long").alias("n"), (F.col("rank") - 1).alias("pos"), "node", "digest")
    root = stored(_raised(over, made)).select("node", hex_text(F.col("digest")).alias("digest")).first()  # one row, none for an empty table
    runs = runs.join(tops.select(F.col("tree").alias("base"), F.col("digest").alias("subroot")), "base")
    links = None
    for step in made:
        each = step.select(F.col("node").alias("parent"), F.inline("members"))
        links = each if links is None else links.unionByName(each)
    if links is None:
        links = leaves.where("false").select(F.col("node").alias("parent"), "node", F.lit(0).alias("place"), F.array("leaf").alias("path"))
    nodes = links.select("node", "parent", "place", "path")
    return Manifest(leaves, nodes, runs, root["node"] if root else None, root["digest"] if root else None)


_NOW = "lower(hex(c.folded))"
_SIBLING = "lower(hex(get(n.path, k)))"
_FOLD = (f"unhex(aggregate(sequence(0, size(n.path) - 1), {_NOW}, (now, k) -> sha2(CASE WHEN get(n.path, k) IS NULL THEN now "
         f"WHEN shiftright(n.place, k) % 2 = 1 THEN concat({_SIBLING}, now) ELSE concat(now, {_SIBLING}) END, 256)))")
_APPENDED = "aggregate(n.path, {}, (all, x) -> concat(all, coalesce(x, CAST('' AS BINARY))))"
_CLIMB = f"""
WITH RECURSIVE climb(g, node, part, folded, siblings) AS (
  SELECT c.g, coalesce(n.parent, c.node), CAST(0 AS INT), CASE WHEN n.path IS NULL THEN c.folded ELSE {_FOLD} END,
    CASE WHEN n.path IS NULL THEN CAST('' AS BINARY) ELSE {_APPENDED.format("CAST('' AS BINARY)")} END
  FROM {{claims}} c LEFT JOIN {{low}} n ON n.node = c.node
  UNION ALL
  SELECT c.g, n.parent, CAST(CASE WHEN n.parent % {STEPS} >= 2 THEN c.g % {{copies}} ELSE 0 END AS INT), {_FOLD}, {_APPENDED.format("c.siblings")}
  FROM climb c JOIN {{high}} n ON n.node = c.node AND n.copy = c.part)
SELECT g, folded, siblings FROM climb WHERE node = {{root}} LIMIT ALL
"""


def climbed(manifest: Manifest, claims: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, copies: int = COPIES) -> DataFrame:
    """Per claim (g, node, folded: the digest that a leaf is said to have): folded (the root that it gives) and siblings."""
    if manifest.root_node is None:
        return claims.select("g", "folded", F.col("folded").alias("siblings")).where("false")
    low, high = manifest.nodes.where(F.col("node") % STEPS == 0), manifest.nodes.where(F.col("node") % STEPS > 0)
    if high.count() * (64 + 64 * LEVELS) <= broadcast_bytes:
        copies, high = 1, F.broadcast(high.withColumn("copy", F.lit(0)))
    else:
        each = F.when(F.col("node") % STEPS >= 2, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
        high = high.withColumn("copy", F.explode(each))
    return claims.sparkSession.sql(_CLIMB, claims=claims, low=low, high=high, copies=copies, root=manifest.root_node)


def hashed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, run, leaf and ``changed``: the leaf with n_chars + 1 for rows that the tampering picks."""
    cols = {c: F.col(c) for c in COLUMNS}
    picked = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = cols | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return docs.select(*COLUMNS).select("doc_id", F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("run"),
                                        digest(list(cols.values())).alias("leaf"), F.when(picked, digest(list(more.values()))).alias("changed"))


def verified_documents(docs: DataFrame) -> DataFrame:
    """Per row: its leaf, subroot and root, the digest of its proof, and whether the claimed leaf leads to the root."""
    manifest = build_manifest(hashed_documents(docs))
    claims = manifest.leaves.select("g", "node", F.coalesce("changed", "leaf").alias("folded"))
    found = stored(climbed(manifest, claims).select("g", "folded", F.sha2(hex_text(F.col("siblings")), 256).alias("proof_sha256")))
    whole = manifest.leaves.select("g", "doc_id", "run", "leaf").join(found, "g")
    runs = manifest.runs.select("run", F.col("n").alias("_n"), "subroot")
    joined = join_hot(whole, runs, "run", "_n", manifest.leaves.count())
    root = F.lit(manifest.root)
    return joined.select("doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), root.alias("root"),
                         "proof_sha256", hex_text(F.col("folded")).alias("folded_root"),
                         (hex_text(F.col("folded")) == root).alias("verified"))


_TEXT = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_TEXT.format(c) for c in COLUMNS)
_ORACLE = f"""
WITH RECURSIVE
bits(doc_id, rest, crc) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, substr(rest, 2), list_reduce(list_prepend(xor(crc, ascii(rest)::BIGINT), range(8)::BIGINT[]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)
  FROM bits WHERE rest <> ''),
picked AS (SELECT doc_id FROM bits WHERE rest = '' AND xor(crc, 4294967295::BIGINT) % 7 = 0),
d AS (SELECT doc_id, coalesce('1' || lang, '0') AS run, sha256({_LEAF}) AS leaf,
    CASE WHEN doc_id IN (SELECT doc_id FROM picked) AND n_chars IS NOT NULL THEN sha256({_LEAF.replace("n_chars::", "(n_chars + 1)::")}) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low(run, lv, pos, digest) AS (
  SELECT run, 0, pos, leaf FROM l
  UNION ALL
  SELECT run, lv + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM low) WHERE n > 1 GROUP BY run, lv, pos // 2),
tops AS (SELECT run, max(lv) AS height FROM low GROUP BY run),
subroots AS (SELECT run, height, digest AS subroot, row_number() OVER (ORDER BY encode(run)) - 1 AS pos FROM tops JOIN low USING (run) WHERE lv = height),
up(lv, pos, digest) AS (
  SELECT 0, pos, subroot FROM subroots
  UNION ALL
  SELECT lv + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM up) WHERE n > 1 GROUP BY lv, pos // 2),
root AS (SELECT digest AS root FROM up WHERE lv = (SELECT max(lv) FROM up)),
nodes AS (SELECT low.run, lv, low.pos, digest FROM low JOIN subroots USING (run) WHERE lv < height
  UNION ALL SELECT NULL, lv, pos, digest FROM up WHERE lv < (SELECT max(lv) FROM up)),
fold(run, leaf_pos, tree, lv, pos, folded, siblings) AS (
  SELECT run, pos, run, 0, pos, coalesce(changed, leaf), '' FROM l
  UNION ALL
  SELECT f.run, f.leaf_pos, CASE WHEN f.tree IS NOT NULL AND f.lv = s.height THEN NULL ELSE f.tree END,
    CASE WHEN f.tree IS NOT NULL AND f.lv = s.height THEN 0 ELSE f.lv + 1 END,
    CASE WHEN f.tree IS NOT NULL AND f.lv = s.height THEN s.pos ELSE f.pos // 2 END,
    CASE WHEN f.tree IS NOT NULL AND f.lv = s.height THEN f.folded WHEN f.pos % 2 = 1 THEN sha256(n.digest || f.folded) ELSE sha256(f.folded || coalesce(n.digest, '')) END,
    f.siblings || CASE WHEN f.tree IS NOT NULL AND f.lv = s.height THEN '' ELSE coalesce(n.digest, '') END
  FROM fold f JOIN subroots s USING (run) LEFT JOIN nodes n ON n.run IS NOT DISTINCT FROM f.tree AND n.lv = f.lv AND n.pos = xor(f.pos, 1)
  WHERE f.tree IS NOT NULL OR f.lv < (SELECT max(lv) FROM up))
SELECT l.doc_id, l.leaf, s.subroot, root, sha256(f.siblings) AS proof_sha256, f.folded AS folded_root, f.folded = root AS verified
FROM l JOIN subroots s USING (run), root, (SELECT * FROM fold WHERE tree IS NULL AND lv = (SELECT max(lv) FROM up)) f WHERE f.run = l.run AND f.leaf_pos = l.pos
"""


@register("op12_merkle_manifest", _ORACLE)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verdict of every document."""
    return verified_documents(table(spark, sf_dir, "documents"))
