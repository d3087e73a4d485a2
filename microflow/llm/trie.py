"""Prefix trie of conversations by partition refinement: classes of equal beginnings are split turn by turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microflow.llm.common import drop, numbered, table, written

#: Turns of a conversation that are summed in one window, and ids that are joined to one string.
STRETCH, CHUNK = 4096, 8192
_MARKS = ["f0", "f1", "f2", "f3"]


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each item's chunks in a row, comma-joined; rows come sorted, and only one digest is open at a time."""
    item, running = None, None
    for part in parts:
        out = []
        for i, text in zip(part["item"].tolist(), part["text"].tolist()):
            if running is None or i != item:
                if running is not None:
                    out.append((item, running.hexdigest()))
                item, running = i, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        yield pd.DataFrame(out, columns=["end_item", "ends_sha256"])
    if running is not None:
        yield pd.DataFrame([(item, running.hexdigest())], columns=["end_item", "ends_sha256"])


def folded(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, members): each distinct sequence of turns as (item, w, len), and (item, conv_id) of the w conversations that have it.

    Sequences are told apart by the exclusive or of a SHA-256 a turn and depth, so no task holds a conversation, and of
    many equal conversations a row per task is left before anything is shuffled.
    """
    sha = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("key")), 256)
    part = lambda k: F.bit_xor(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("long"))
    marks = turns.groupBy("conv_id").agg(F.count("*").alias("len"), *[part(k).alias(f) for k, f in enumerate(_MARKS)])
    marks = conversations.join(marks, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("len", *_MARKS)])
    marks = written(marks, "marks")
    items = written(marks.groupBy("len", *_MARKS).agg(F.min("conv_id").alias("item"), F.count("*").alias("w")), "items")
    members = marks.join(items, ["len", *_MARKS]).select("item", "conv_id")
    return items.select("item", "w", "len"), members


def ends(members: DataFrame) -> DataFrame:
    """(end_item, ends_sha256): digest of each item's conversation ids, ascending and comma-joined.

    Ids are first joined by ranges of CHUNK numbers, so a string is bounded; the strings of an item are hashed as a stream.
    """
    chunks = members.groupBy("item", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("text"))
    return chunks.repartition("item").sortWithinPartitions("item", "chunk").select("item", "text").mapInPandas(_digests, "end_item long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (1, 2, ... without holes), key (equal for equal turns), chars. conversations: the distinct conv_id of
    all, those without turns too; null ids aren't allowed. A node is a distinct beginning, named by its smallest member and its depth.

    Equal conversations are folded into one weighted item first. All items are one class at the root; a round
    splits each active class by its members' next turn. A class of one item is retired, and the rest of its turns becomes a
    chain of nodes at once, so there are as many rounds as the longest beginning that two different conversations
    share. Classes are then folded back, deepest first, into their parents. A class is aggregated in the tasks
    before it is shuffled, and joins only follow written tables, so a hot class can be split. No conversations: no nodes.
    """
    items, members = folded(turns, conversations)
    items = written(items, "trie-items")
    steps = turns.join(items, turns["conv_id"] == items["item"]).select("item", "depth", "key", "chars", "w", "len")
    order = ["depth", "item"]
    steps = written(steps.repartitionByRange(*order).sortWithinPartitions(*order), "trie-turns")
    last = lambda d: F.max(F.when(F.col("len") == d, F.col("item"))).alias("end_item")
    # first the classes of each depth; then `active`, the items of classes that are still to be split
    root = items.agg(F.min("item").alias("conv_id"), F.count("*").alias("items"), F.sum("w").alias("n_convs"), last(0)).where("conv_id is not null")
    root = written(root.select(F.lit(None).cast("long").alias("parent_conv_id"), F.lit(None).cast("binary").alias("key"), "conv_id", "items", "n_convs", F.lit(0).cast("long").alias("chars"), "end_item", F.lit(0).alias("depth")), "trie-level")
    levels, top = [root], root.first()
    active = items.select("item", F.lit(top["conv_id"] if top else None).cast("long").alias("cls"))
    more = top is not None and top["items"] > 1
    while more:
        d = len(levels)
        here = steps.where(F.col("depth") == d).join(active, "item")
        found = here.groupBy("cls", "key").agg(F.min("item").alias("conv_id"), F.count("*").alias("items"), F.sum("w").alias("n_convs"), F.min("chars").alias("chars"), last(d))
        found = written(found.withColumnRenamed("cls", "parent_conv_id").withColumn("depth", F.lit(d)), "trie-level")
        levels.append(found)
        split = found.where("items > 1").select(F.col("parent_conv_id").alias("cls"), "key", F.col("conv_id").alias("next"))
        more = bool(split.limit(1).count())
        if more:
            was, active = active, written(here.join(split, ["cls", "key"]).select("item", F.col("next").alias("cls")), "trie-active")
            drop(was)
    drop(active)

    # chains below the classes of one item
    single = _all(levels).where("items = 1")
    tail = steps.join(single.select(F.col("conv_id").alias("item"), F.col("depth").alias("from")), "item").where("depth > from").withColumn("stretch", F.expr(f"depth div {STRETCH}"))
    sums = tail.groupBy("item", "stretch").agg(F.sum("chars").alias("s"))
    below = Window.partitionBy("item").orderBy(F.col("stretch").desc())
    sums = sums.select(F.col("item").alias("of"), F.col("stretch").alias("part"), (F.sum("s").over(below.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("deeper"), F.sum("s").over(below.rowsBetween(Window.unboundedPreceding, 0)).alias("all"))
    sums = written(sums, "trie-tails")
    own = Window.partitionBy("item", "stretch").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    chain = tail.withColumn("inner", F.sum("chars").over(own)).join(sums, (F.col("item") == F.col("of")) & (F.col("stretch") == F.col("part")))
    inside = F.col("depth") < F.col("len")
    chain = chain.select(
        F.col("item").alias("conv_id"), "depth", F.col("item").alias("parent_conv_id"), F.col("w").alias("n_convs"), inside.cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("inner") + F.col("deeper"))).alias("saved_tokens"), F.when(~inside, F.col("item")).alias("end_item"),
    )
    columns = chain.columns
    rest = sums.groupBy("of").agg(F.max("all").alias("all"))
    single = single.join(rest, F.col("conv_id") == F.col("of"), "left").withColumns({"n_children": F.col("of").isNotNull().cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * (F.col("chars") + F.coalesce("all", F.lit(0)))})
    single = written(single.select(*columns), "trie-single")

    # the split classes, deepest first: each adds up its children
    whole, child = [], None
    for d in reversed(range(len(levels))):
        here = levels[d].where("items > 1")
        under = single.where(F.col("depth") == d + 1)
        under = (under if child is None else under.unionByName(child)).groupBy(F.col("parent_conv_id").alias("of")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under"))
        child = written(here.join(under, F.col("conv_id") == F.col("of")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars") + F.col("under")).select(*columns), "trie-whole")
        whole.append(child)
    nodes = _all([*whole, single, chain])
    ended = nodes.where("end_item is not null").join(ends(members), "end_item")
    nodes = ended.unionByName(nodes.where("end_item is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256)))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def keyed(messages: DataFrame) -> DataFrame:
    """(conv_id, depth, key, chars) of messages (conv_id, turn, role, text): turns by number, null first, ties by role and then key.

    Null roles and texts count as empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    m = messages.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"), F.length(text).cast("long").alias("chars"))
    m = written(m, "turn-keys")
    placed = numbered(m, ["conv_id"], ["turn", "role", "key"], "depth")
    out = written(placed.select("conv_id", (F.col("depth") + 1).alias("depth"), "key", "chars"), "turns")
    drop(m)
    return out


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which the first h turns of each conversation c come from the one that begins its block.

    h = crc32(decimal c) % heads; the block's first is c - c % block. If that has fewer turns, all are taken, and none if it is
    absent; c's own turns after its first h follow.
    """
    first = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(block))
    lead = turns.where((F.col("conv_id") == first) & (F.col("depth") < heads)).groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("depth", "key", "chars"))).alias("lead"))
    convs = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads).withColumn("first", first).join(lead, "first", "left")
    convs = convs.withColumn("lead", F.filter(F.coalesce("lead", F.array().cast("array<struct<depth:bigint,key:binary,chars:bigint>>")), lambda x: x["depth"] <= F.col("h")))
    convs = written(convs.select("conv_id", "h", "lead"), "leads")
    shift = convs.select("conv_id", "h", F.size("lead").alias("led"))
    own = turns.join(shift, "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("led")).alias("depth"), "key", "chars")
    shared = convs.select("conv_id", F.explode("lead").alias("x")).select("conv_id", "x.depth", "x.key", "x.chars")
    return written(own.unionByName(shared), "rebuilt"), convs.select("conv_id")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(keyed(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations),
convs AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM turns)),
parts AS (SELECT v.c, 0 AS part, n, r, x FROM convs v JOIN turns t ON t.c = v.base AND n <= h
  UNION ALL SELECT v.c, 1, n, r, x FROM convs v JOIN turns t ON t.c = v.c AND n > h),
rows AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, n) AS d, strlen(r) || ':' || r || strlen(x) || ':' || x AS said, length(x) AS chars FROM parts),
paths AS (SELECT c, d, chars, sha256(string_agg(said, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM rows UNION ALL SELECT c, 0, 0, 'root' FROM convs),
steps AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (SELECT p, d, parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM steps GROUP BY p, d, parent),
children AS (SELECT parent AS p, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
below AS (SELECT s.p, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(k.saved) AS saved_tokens FROM known k JOIN steps s ON s.c = k.conv_id AND s.d <= k.d GROUP BY s.p)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN below USING (p) LEFT JOIN nodes up ON up.p = k.parent"""
