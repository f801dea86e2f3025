"""A Merkle manifest of a dataset: a hash tree per part, proofs per row, and their check.

Every row is a leaf. The leaves of a part stand in order of their ids; ``fanout``
consecutive nodes have one parent, whose digest is the hash of their digests. Levels
are built by a slot pivot: rows are grouped by parent, conditional aggregates spread
the children into one column per slot, joining the columns gives what is hashed, and
joining all but a child's own column gives its siblings. The roots of the parts are the
leaves of one more tree.

Levels are taken in rounds. A round cuts a tree into blocks of consecutive nodes and
climbs from them to one node without another shuffle, since a parent lies in the block
of its children. Blocks are bounded, whatever the size of a part, so a part with a third
of all rows is spread like any other. Between rounds only one node per block is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridtally.session import materialize

FANOUT = 2
# Nodes that one block of a round takes in, at most.
BLOCK_NODES = 256
DIVISOR = 7


def encoded(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its bytes counted, ``:``, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(value) for value in values]), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0 in each ``tree`` by ``order``, and its size ``n``, stored.

    Rows are sorted by ranges of tree and order. Their place in a partition is known at
    once, where a partition begins in its tree from one count per partition and tree.
    """
    row = F.monotonically_increasing_id()
    # The number of the row before sorting deals out rows that are the same.
    sort = ["tree", *order, "_row"]
    ranged = rows.withColumn("_row", row).repartitionByRange(*sort).sortWithinPartitions(*sort)
    ordered = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), "ordered_nodes")
    ordered = ordered.withColumn("_part", F.shiftright("_place", 33))
    parts = ordered.groupBy("tree", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("n"),
    )
    joined = ordered.join(parts, ["tree", "_part"])
    placed = joined.withColumn("pos", F.col("_before") + F.col("_place") - F.col("_first"))
    return materialize(placed.drop("_part", "_place", "_row", "_first", "_before", "_rows"), "placed_nodes")


def _pivoted(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level up: a row per parent, from ``tree, block, n, pos, digest, members``.

    ``n`` counts the nodes of the level in the tree; a tree of one node stays as it is. A
    member keeps the steps of its proof: what stands left and right of it in each hash.
    """
    slot, members = F.pmod("pos", F.lit(fanout)), nodes.schema["members"].dataType
    columns = [
        F.max(F.when(slot == i, F.struct("digest", "members"))).alias(f"s{i}") for i in range(fanout)
    ]
    parent = F.floor(F.col("pos") / fanout).cast("long").alias("pos")
    spread = nodes.groupBy("tree", "block", F.col("n").alias("before"), parent).agg(*columns)
    digests = [F.coalesce(F.col(f"s{i}.digest"), F.lit("")) for i in range(fanout)]
    many = F.col("before") > 1

    def grown(i: int) -> Column:
        left = F.concat(F.lit(""), *digests[:i]).alias("left")
        right = F.concat(F.lit(""), *digests[i + 1 :]).alias("right")
        none = F.array().cast("array<struct<left:string,right:string>>")
        step = F.when(many, F.array(F.struct(left, right))).otherwise(none)
        own = F.coalesce(F.col(f"s{i}.members"), F.array().cast(members))
        longer = lambda m: F.struct(m["pos"], m["item"], F.concat(m["path"], step).alias("path"))
        return F.transform(own, longer)

    return spread.select(
        "tree", "block", F.ceil(F.col("before") / fanout).cast("long").alias("n"), "pos",
        F.when(many, F.sha2(F.concat(*digests), 256)).otherwise(digests[0]).alias("digest"),
        F.concat(*[grown(i) for i in range(fanout)]).alias("members"),
    )


def _round(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``tree, pos, n, digest, members`` of the tops of the blocks of ``tree, pos, n, digest, item``."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    rows = nodes.select(
        "tree", F.floor(F.col("pos") / fanout**levels).cast("long").alias("block"), "n", "pos", "digest",
        F.array(F.struct("pos", "item", none.alias("path"))).alias("members"),
    ).repartition("tree", "block")
    for _ in range(levels):
        rows = _pivoted(rows, fanout)
    return materialize(rows.drop("block"), "tree_blocks")


def climb(nodes: DataFrame, fanout: int = FANOUT, block_nodes: int = BLOCK_NODES) -> list[DataFrame]:
    """The rounds that lead from ``tree, pos, n, digest, item`` to one node per tree."""
    rounds: list[DataFrame] = []
    while True:
        most, levels = nodes.agg(F.max("n").alias("n")).first()["n"] or 0, 0
        if rounds and most <= 1:
            return rounds
        while most > 1 and fanout ** (levels + 1) <= max(block_nodes, fanout):
            most, levels = -(-most // fanout), levels + 1
        rounds.append(_round(nodes, fanout, levels))
        nodes = rounds[-1].select("tree", "pos", "n", "digest", F.lit(None).cast("string").alias("item"))


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``item, path`` and the rest of ``tops`` for every node that the rounds began with.

    ``tops`` has ``tree, path`` and more columns per tree; its path follows that in the tree.
    """
    rest = [name for name in tops.columns if name not in ("tree", "path")]
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        met = blocks.select("tree", "pos", "members").join(above, ["tree", "pos"])
        member = met.select("tree", F.explode("members").alias("m"), F.col("path").alias("_above"), *rest)
        above = member.select(
            "tree", F.col("m.pos").alias("pos"), F.col("m.item").alias("item"),
            F.concat("m.path", "_above").alias("path"), *rest,
        )
        if blocks is not rounds[0]:
            above = above.drop("item")
    return above.drop("pos")


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and the steps of its proof lead to."""
    return F.aggregate(path, digest, lambda found, step: F.sha2(F.concat(step["left"], found, step["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """The hash of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.concat(F.lit(""), F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")), 256)


def manifest(
    leaves: DataFrame, fanout: int = FANOUT, block_nodes: int = BLOCK_NODES
) -> DataFrame:
    """``tree, id, leaf, extra, subroot, root, path`` for each row of ``leaves``.

    ``leaves`` has ``tree, id, leaf, extra``: the part a row belongs to, its place in the
    part, its digest, and anything to carry along. Parts are ordered bytewise, a null part
    first; rows by id, null first, then by digest. Rows that repeat an id stay rows of
    their own. ``path`` is the proof: per level what stands left and right of the node in
    the hash of its parent. A part of one row has no level of its own, and so has a
    dataset of one part. No rows give no rows.
    """
    # A null part is the empty name, and every other name begins with a mark.
    tree = F.coalesce(F.concat(F.lit("+"), F.col("tree").cast("string")), F.lit(""))
    stored = materialize(leaves.withColumn("tree", tree), "leaves")
    placed = _placed(stored, ["id", "leaf"])
    item = F.struct("id", "leaf", "extra").alias("item")
    rounds = climb(placed.select("tree", "pos", "n", F.col("leaf").alias("digest"), item), fanout, block_nodes)
    subroots = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    parts = _placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), "subroot"), ["part"])
    part = F.struct("part", "subroot").alias("item")
    upper = climb(parts.select("tree", "pos", "n", F.col("subroot").alias("digest"), part), fanout, block_nodes)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = upper[-1].select("tree", F.col("digest").alias("root"), none.alias("path"))
    tops = descend(upper, root).select(F.col("item.part").alias("tree"), "path", "item.subroot", "root")
    found = descend(rounds, tops)
    name = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return found.select(
        name.alias("tree"), "item.id", "item.leaf", "item.extra", "subroot", "root", "path"
    )


def document_leaf(n_chars: Column) -> Column:
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))


def verified_manifest(docs: DataFrame, divisor: int = DIVISOR, **options: int) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document.

    Parts are languages. Where ``divisor`` divides the CRC-32 of the decimal doc_id, the
    row is checked after 1 was added to its ``n_chars``; a null ``n_chars`` stays null, and
    a row without an id is left alone, so both verify. Any other column may be null or
    empty; texts are hashed whole; columns beyond the five of a leaf are not looked at.
    """
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == 0
    changed = F.when(tampered & F.col("n_chars").isNotNull(), document_leaf(F.col("n_chars") + 1))
    leaves = docs.select(
        F.col("lang").alias("tree"), F.col("doc_id").alias("id"),
        document_leaf(F.col("n_chars")).alias("leaf"), changed.alias("extra"),
    )
    proofs = manifest(leaves, **options).withColumn(
        "folded_root", folded(F.coalesce("extra", "leaf"), F.col("path"))
    )
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``verified_manifest`` of the whole of ``documents``, with two children a node."""
    return verified_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE enc AS (
    SELECT doc_id, lang, n_chars,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail,
           list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
               lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
    FROM documents
), leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
           CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
                THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS tampered
    FROM enc
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), nodes(tree, l, pos, d, n) AS (
    SELECT coalesce('+' || lang, ''), 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM placed
    UNION ALL
    SELECT tree, l + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2
    FROM nodes WHERE n > 1 GROUP BY tree, l, n, pos // 2
), subroots AS (
    SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1
), upper(l, pos, d, n) AS (
    SELECT 0, pos, d, count(*) OVER () FROM subroots
    UNION ALL
    SELECT l + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2
    FROM upper WHERE n > 1 GROUP BY l, n, pos // 2
), steps AS (
    SELECT p.doc_id, p.leaf, p.pos, coalesce('+' || p.lang, '') AS tree, a.l,
           CASE WHEN (p.pos >> a.l) % 2 = 0 THEN 'R' ELSE 'L' END || coalesce(b.d, '') AS step
    FROM placed p
    JOIN nodes a ON a.tree = coalesce('+' || p.lang, '') AND a.n > 1 AND a.pos = p.pos >> a.l
    LEFT JOIN nodes b ON b.tree = a.tree AND b.l = a.l AND b.pos = xor(a.pos, 1::BIGINT)
    UNION ALL
    SELECT p.doc_id, p.leaf, p.pos, s.tree, 1000 + a.l,
           CASE WHEN (s.pos >> a.l) % 2 = 0 THEN 'R' ELSE 'L' END || coalesce(b.d, '')
    FROM placed p JOIN subroots s ON s.tree = coalesce('+' || p.lang, '')
    JOIN upper a ON a.n > 1 AND a.pos = s.pos >> a.l
    LEFT JOIN upper b ON b.l = a.l AND b.pos = xor(a.pos, 1::BIGINT)
), proofs AS (
    SELECT tree, pos, list(step ORDER BY l) AS steps FROM steps GROUP BY tree, pos
), found AS (
    SELECT p.doc_id, p.leaf, s.d AS subroot, (SELECT d FROM upper WHERE n = 1) AS root,
           sha256(coalesce(list_reduce(list_prepend('', list_transform(steps, lambda x: x[2:])), lambda a, b: a || b), '')) AS proof_sha256,
           list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(steps, [])),
             lambda a, b: sha256(CASE WHEN b[1] = 'L' THEN b[2:] || a ELSE a || b[2:] END)) AS folded_root
    FROM placed p JOIN subroots s ON s.tree = coalesce('+' || p.lang, '')
    LEFT JOIN proofs f ON f.tree = s.tree AND f.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM found
"""
