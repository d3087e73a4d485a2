"""Merkle manifest of a dataset: a root over all rows, and for each row the siblings that prove it."""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.llm.common import col, drop, numbered, partitions, table, written

#: Levels of the tree that one vertex stands for: it takes messages from up to 2**LEVELS children.
LEVELS = 10

NODES = "tree long, n long, pos long, id long, digest string, audited string"
VERTICES = "tree long, n long, block long, digests array<string>, ids array<long>, audited array<string>, top string"
PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of all values in a row: `-` for null, else UTF-8 byte count, colon and value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _rows(digests: list[str], levels: int) -> list[list[str]]:
    """A run of nodes and the levels above it, pair by pair; a node without a neighbour goes up by itself."""
    out = [digests]
    for _ in range(levels):
        row = out[-1]
        out.append([_h(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return out


def _height(n: int) -> int:
    return (n - 1).bit_length()


def _levels(n: int, step: int) -> int:
    """How many levels a vertex of this superstep hashes in a tree of n leaves."""
    return max(0, min(LEVELS, _height(n) - step * LEVELS))


def _completed(step: int, vertex: tuple) -> tuple:
    """A vertex that has heard from all its children: it puts them in order and hashes up to its top."""
    (tree, n, block), messages = vertex
    messages = sorted(messages, key=lambda m: m[0])
    digests = [m[1] for m in messages]
    return tree, n, block, digests, [m[2] for m in messages], [m[3] for m in messages], _rows(digests, _levels(n, step))[-1][0]


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(vertices of each superstep, (tree, n, root)): digests sent upwards until each tree has its root.

    nodes: tree, n (leaves of the tree), pos (0 to n - 1), id, digest, audited. In a superstep children message the
    vertex above them; completed, it hashes and forwards its top. A vertex stands for LEVELS levels, so it gets 2**LEVELS
    messages at most, a hot tree is spread over many vertices, and a tree of 2**40 leaves takes four supersteps. Vertices
    are a written table after each superstep, so a lost executor costs one superstep.
    """
    spark = nodes.sparkSession
    highest, states, step = nodes.agg(F.max("n")).first()[0] or 0, [], 0
    sent: RDD = nodes.rdd.map(lambda r: ((r[0], r[1], r[2] >> LEVELS), (r[2], r[4], r[3], r[5])))
    while highest and (step == 0 or 1 << step * LEVELS < highest):
        done = sent.groupByKey(partitions(spark)).map(partial(_completed, step))
        states.append(written(spark.createDataFrame(done, VERTICES, verifySchema=False), "vertices"))
        step += 1
        sent = states[-1].where(F.col("n") > (1 << step * LEVELS)).select("tree", "n", "block", "top").rdd.map(lambda r: ((r[0], r[1], r[2] >> LEVELS), (r[2], r[3], None, None)))
    tops = [s.where((F.col("n") <= (1 << (k + 1) * LEVELS)) & (F.lit(k == 0) | (F.col("n") > (1 << k * LEVELS)))).select("tree", "n", F.col("top").alias("root")) for k, s in enumerate(states)]
    out = tops[0] if tops else nodes.select("tree", "n", F.col("digest").alias("root"))
    for t in tops[1:]:
        out = out.unionByName(t)
    return states, out


def _below(step: int, joined: tuple) -> list:
    """What a vertex sends down: to each child its siblings within the vertex, level by level, and the path above it.

    A step of a path is the sibling's digest after R or L, the side it stands on, or nothing where there is none.
    """
    (tree, block), ((n, digests, ids, audited), (above, note)) = joined
    rows = _rows(digests, _levels(n, step))[:-1]
    out = []
    for i in range(len(digests)):
        own = tuple((("R" if (i >> k) % 2 == 0 else "L") + row[j]) if (j := (i >> k) ^ 1) < len(row) else "" for k, row in enumerate(rows))
        child = (block << LEVELS) + i
        out.append(((tree, child), (own + above, note)) if step else (ids[i], digests[i], audited[i], own + above, note))
    return out


def descend(states: list[DataFrame], tops: RDD, parts: int) -> RDD:
    """(id, digest, audited, path, note) of each leaf: sibling paths broadcast downwards in reverse supersteps.

    tops: (tree, n, path above the tree, note) of each tree; a note is handed down to all its leaves.
    """
    down = None
    for step in reversed(range(len(states))):
        vertices = states[step].rdd.map(lambda r: ((r[0], r[2]), (r[1], r[3], r[4], r[5])))
        begun = tops.filter(lambda t, s=step: max(0, _height(t[1]) - 1) // LEVELS == s).map(lambda t: ((t[0], 0), (t[2], t[3])))
        told = begun if down is None else begun.union(down)
        down = vertices.join(told, parts).flatMap(partial(_below, step))
    return down


def fold(leaf: str, path: tuple) -> str:
    """The root that a leaf and its sibling path lead to."""
    for x in path:
        leaf = _h(leaf) if not x else _h(leaf, x[1:]) if x[0] == "R" else _h(x[1:], leaf)
    return leaf


def _proof(root: str, leaf: tuple) -> tuple:
    id_, own, audited, path, subroot = leaf
    folded = fold(own if audited is None else audited, path)
    return id_, own, subroot, root, _h(*[x[1:] for x in path]), folded, folded == root


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), audited: dict[str, Column] | None = None, audit_where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, proofs): (group, n, subroot, root), and per row (id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Each row is a leaf, the digest of its columns. Per group, leaves in ascending order of id (null first, ties by digest)
    are hashed pair by pair to a subroot, the groups' subroots (null first, then UTF-8 bytewise) likewise to the root. proof_sha256 is
    the digest of a leaf's siblings, level by level. folded_root is computed anew from the leaf and these siblings; audited
    names columns whose present value is to be proven instead of the recorded one, in the rows of audit_where.

    Nulls have a digest of their own, texts of any length go in whole, repeated rows and ids are leaves of their own, other columns are
    ignored whatever their names. A single group's subroot is the root. An empty table has no groups and no proofs.
    """
    spark = docs.sparkSession
    values = {c: col(c) for c in columns}
    changed = digest([(audited or {}).get(c, v) for c, v in values.items()])
    leaves = docs.select(col(group_col).alias("grp"), col(id_col).cast("long").alias("id"), digest(list(values.values())).alias("digest"), (F.when(F.coalesce(audit_where if audit_where is not None else F.lit(True), F.lit(False)), changed) if audited else F.lit(None)).cast("string").alias("audited"))
    leaves = written(leaves, "leaves")
    placed = numbered(leaves, ["grp"], ["id", "digest"], "pos")
    groups = written(numbered(leaves.groupBy("grp").agg(F.count("*").alias("n")), [], ["grp"], "tree"), "groups")
    nodes = written(placed.join(groups.withColumnRenamed("grp", "of"), F.col("grp").eqNullSafe(F.col("of"))).select("tree", "n", "pos", "id", "digest", "audited"), "nodes")
    drop(leaves)
    states, subroots = climb(nodes)
    subroots = written(subroots, "subroots")
    drop(nodes)
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(groups.count()).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("tree").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("audited"))
    above, roots = climb(over)
    found = roots.first()
    root = found["root"] if found else None
    listed = groups.join(subroots.select(F.col("tree"), F.col("root").alias("subroot")), "tree").select(col("grp").alias(group_col), "n", "subroot", F.lit(root).alias("root"))
    if root is None:
        return listed, spark.createDataFrame([], PROOFS)
    parts = partitions(spark)
    sizes = subroots.rdd.map(lambda r: (r[0], r[1]))
    ways = descend(above, spark.sparkContext.parallelize([(0, found["n"], (), None)], 1), parts).map(lambda x: (x[0], (x[3], x[1])))
    tops = ways.join(sizes, parts).map(lambda x: (x[0], x[1][1], x[1][0][0], x[1][0][1]))
    proofs = descend(states, tops, parts).map(partial(_proof, root))
    return listed, spark.createDataFrame(proofs, PROOFS, verifySchema=False)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    _, proofs = manifest(table(spark, sf_dir, "documents"), audited={"n_chars": F.col("n_chars") + 1}, audit_where=tampered)
    return proofs.withColumnRenamed("id", "doc_id")


#: A list of nine numbers a digit drives the checksum: the digit, then eight shifts. A step of a path is the sibling and its side.
SQL = r"""
WITH RECURSIVE d AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS crc FROM documents),
coded AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
    coalesce(strlen(text) || ':' || text, '-') AS back FROM d),
leaves AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    sha256(front || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || back) AS leaf,
    sha256(front || coalesce(strlen(CAST(n_chars + (crc % 7 = 0)::INT AS VARCHAR)) || ':' || (n_chars + (crc % 7 = 0)::INT), '-') || back) AS shown FROM coded),
nodes AS (SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subroots AS (SELECT lang, lvl, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n),
root AS (SELECT h AS root FROM tops WHERE n = 1),
inner_steps AS (SELECT l.doc_id, s.lvl, CASE WHEN o.h IS NULL THEN '-' WHEN s.pos % 2 = 1 THEN 'L' || o.h ELSE 'R' || o.h END AS step
  FROM leaves l JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.pos = l.pos // (1::BIGINT << s.lvl) AND s.n > 1
  LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM s.lang AND o.lvl = s.lvl AND o.pos = xor(s.pos, 1)),
outer_steps AS (SELECT l.doc_id, 1000 + s.lvl AS lvl, CASE WHEN o.h IS NULL THEN '-' WHEN s.pos % 2 = 1 THEN 'L' || o.h ELSE 'R' || o.h END AS step
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN tops s ON s.pos = r.pos // (1::BIGINT << s.lvl) AND s.n > 1
  LEFT JOIN tops o ON o.lvl = s.lvl AND o.pos = xor(s.pos, 1)),
paths AS (SELECT doc_id, list(step ORDER BY lvl) AS steps FROM (FROM inner_steps UNION ALL FROM outer_steps) GROUP BY doc_id),
folded AS (SELECT l.doc_id, leaf, lang, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(shown, coalesce(steps, [])), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root
  FROM leaves l LEFT JOIN paths USING (doc_id))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded f JOIN subroots r ON r.lang IS NOT DISTINCT FROM f.lang, root"""
