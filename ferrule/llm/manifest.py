r"""Merkle manifest of a dataset: a digest of every row, folded by threes to one root, with a proof for each row.

Nodes of a group (the rows of a source; then the sources) stand in order.  On each
level a window over a group's runs of three collects the run, which is both what
the parent is the digest of and each member's siblings; runs are deduplicated to
their parents before the next level.  Proofs go down again from the root, a join a
level, so that no row ever meets more than its own run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes to a parent.
ARITY = 3
#: Rows to a range in which places are counted, about.
RANGE_ROWS = 200_000

_PATH = "array<struct<left:binary,right:binary>>"


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row: of ``FIELDS``, each as its size in bytes, a colon and its value, or a dash for null.

    A field may be given another value, as in ``leaf_digest(text=...)``.
    """

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(part(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def _placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``at``, the place in its ``group`` by ``order``, and ``held``, the group's size.

    All groups are sorted as one, in ranges.  A place is that within the range and
    group plus what earlier ranges hold of the group, so that a group of any size
    is counted in many tasks.  ``nodes`` is a stored table.
    """
    spark = nodes.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // RANGE_ROWS))
    order = [*(F.col(c).asc_nulls_first() for c in order), F.col("_row")]  # the last tells rows apart that are alike
    dealt = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, "group", *order)
    ranged = materialise(dealt.withColumn("_range", F.spark_partition_id()), name)
    group = Window.partitionBy("group")
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range", "group").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", "group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("held"))
    within = F.row_number().over(Window.partitionBy("_range", "group").orderBy(*order)) - 1
    placed = ranged.withColumn("_in", within).join(sizes, ["_range", "group"])
    return materialise(placed.withColumn("at", F.col("_in") + F.col("_before")).drop("_range", "_row", "_in", "_before"), f"placed-{name}")


def _runs(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """The parents of ``nodes`` (``group, at, held, node``), as such nodes, each with the ``members`` of its run in order."""
    run = Window.partitionBy("group", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    members = F.collect_list(F.struct("at", "node", *carried)).over(run)
    windowed = nodes.withColumn("parent", F.floor(F.col("at") / ARITY)).withColumn("members", members)
    parents = windowed.where(F.col("at") % ARITY == 0)  # a run's first node stands for its parent
    digest = F.sha2(F.array_join("members.node", ""), 256)
    return parents.select("group", F.col("parent").alias("at"), F.ceil(F.col("held") / ARITY).alias("held"), digest.alias("node"), "members")


def _fold(leaves: DataFrame, carried: list[str], name: str) -> list[DataFrame]:
    """The parents of each level, up to that on which no group has several nodes."""
    levels, level, fields = [], leaves, carried
    largest = leaves.agg(F.max("held")).first()[0] or 0
    while largest > 1:
        levels.append(materialise(_runs(level.where("held > 1"), fields), name))
        level, fields, largest = levels[-1], [], -(-largest // ARITY)
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``group, node``: what remains of each group."""
    tops = leaves.where("held = 1").select("group", "node")
    for level in levels:
        tops = tops.unionAll(level.where("held = 1").select("group", "node"))
    return tops


def _unfold(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of each leaf with its ``proof`` up to the root and its group's ``top``.

    ``above`` has ``group, proof, top`` for what remains of each group.
    """

    def remaining(nodes: DataFrame, fields: list[str]) -> DataFrame:
        return nodes.where("held = 1").select("group", "at", *fields).join(above, "group")

    proofs = None
    for k in reversed(range(len(levels))):
        fields = carried if k == 0 else []
        ends = remaining(levels[k], [])
        proofs = ends if proofs is None else proofs.unionByName(ends)
        m = F.col("m")
        beside = lambda keep: F.unhex(F.array_join(F.transform(F.filter("members", keep), lambda x: x["node"]), ""))
        siblings = F.struct(beside(lambda x: x["at"] < m["at"]).alias("left"), beside(lambda x: x["at"] > m["at"]).alias("right"))
        runs = levels[k].select("group", "at", "members").join(proofs, ["group", "at"]).select("group", "members", "proof", "top", F.explode("members").alias("m"))
        proofs = runs.select("group", m["at"].alias("at"), *(m[c].alias(c) for c in fields), F.concat(F.array(siblings), "proof").alias("proof"), "top")
    ends = remaining(leaves, carried)
    return (ends if proofs is None else proofs.unionByName(ends)).select(*carried, "proof", "top")


def merkle_manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, claimed`` for each row of ``docs``, which has the columns ``FIELDS``.

    A leaf is the digest of its row (``leaf_digest``).  The leaves of a source stand in
    order of ``doc_id``; while there are several nodes, each three in a row become
    the digest of their digests end to end; what remains is the source's
    ``subroot``.  Subroots, in order of their source, become the ``root`` likewise.
    ``proof`` has for each level what stands to the left and right of the leaf's
    ancestor in its run, as digests end to end in binary.  ``claimed`` is a column
    of the row, such as the digest of what someone says the row is, and is handed
    on; null without one.

    Nulls are dashes in the digest; null ids and the null source come first.
    Rows that repeat an id stand in order of their digests, rows that repeat
    altogether are leaves each.  Texts of any length are hashed in one piece; other
    columns are not read.  An empty table has an empty manifest.
    """
    # null sorts before every source, the empty one included
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    carried = ["doc_id", "node", "claimed"]
    rows = materialise(docs.select(group.alias("group"), "doc_id", leaf_digest().alias("node"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed")), "leaves")
    leaves = _placed(rows, ["doc_id", "node"], "rows")
    levels = _fold(leaves, ["doc_id", "claimed"], "level")

    tops = materialise(_tops(leaves, levels).select(F.lit("").alias("group"), F.col("group").alias("source"), "node"), "subroots")
    upper = _placed(tops, ["source"], "sources")
    upper_levels = _fold(upper, ["source"], "upper-level")
    last = _tops(upper, upper_levels).first()
    if not last:
        return rows.select("doc_id", F.col("node").alias("leaf"), F.col("node").alias("subroot"), F.col("node").alias("root"), F.lit(None).cast(_PATH).alias("proof"), "claimed")
    end = docs.sparkSession.range(1).select(F.lit("").alias("group"), F.array().cast(_PATH).alias("proof"), F.unhex(F.lit(last["node"])).alias("top"))
    above = materialise(_unfold(upper, upper_levels, end, ["source", "node"]).select(F.col("source").alias("group"), "proof", F.unhex("node").alias("top")), "above")
    proven = _unfold(leaves, levels, above, carried)
    return proven.select("doc_id", F.col("node").alias("leaf"), _hex(F.col("top")).alias("subroot"), F.lit(last["node"]).alias("root"), "proof", "claimed")


def query(spark, sf_dir: str) -> DataFrame:
    """Manifest and proofs; then rows whose id has an even crc32 are tampered with, and all are checked against their proofs."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claimed = F.when(tampered, leaf_digest(text=F.regexp_replace("text", "\n", "")))
    rows = merkle_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), claimed)
    out = rows.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = """
WITH RECURSIVE
rows AS (
  SELECT doc_id, source,
         array_to_string(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
         coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-') AS tampered,
         list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                     lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || body) AS node, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || tampered) ELSE sha256(head || body) END AS claimed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS held
  FROM rows),
nodes AS (
  SELECT 0 AS lvl, source, pos, held, node FROM leaves
  UNION ALL
  SELECT lvl + 1, source, pos // 3, (max(held) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE held > 1 GROUP BY lvl, source, pos // 3),
subroots AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS held FROM nodes WHERE held = 1),
upper AS (
  SELECT 0 AS lvl, pos, held, node FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (max(held) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE held > 1 GROUP BY lvl, pos // 3),
beside AS (
  SELECT lvl, source, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE held > 1 WINDOW w AS (PARTITION BY lvl, source, pos // 3 ORDER BY pos)),
beside_upper AS (
  SELECT lvl, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM upper WHERE held > 1 WINDOW w AS (PARTITION BY lvl, pos // 3 ORDER BY pos)),
steps AS (
  SELECT doc_id, lvl, l, r FROM leaves d JOIN beside b ON b.source IS NOT DISTINCT FROM d.source AND b.pos = d.pos // CAST(3 ** b.lvl AS BIGINT)
  UNION ALL
  SELECT doc_id, 1000 + lvl, l, r FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source JOIN beside_upper b ON b.pos = s.pos // CAST(3 ** b.lvl AS BIGINT)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS k FROM steps),
folds AS (
  SELECT doc_id, 0 AS k, claimed AS node FROM leaves
  UNION ALL
  SELECT doc_id, n.k, sha256(l || node || r) FROM folds f JOIN numbered n USING (doc_id) WHERE n.k = f.k + 1),
folded AS (SELECT doc_id, arg_max(node, k) AS folded_root FROM folds GROUP BY doc_id),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY k) AS siblings FROM numbered GROUP BY doc_id)
SELECT d.doc_id, d.node AS leaf, s.node AS subroot, u.node AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = u.node AS verified
FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source JOIN folded USING (doc_id) LEFT JOIN proofs USING (doc_id), upper u WHERE u.held = 1
"""
