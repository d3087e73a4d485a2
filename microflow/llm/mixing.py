"""Mixing sources to target weights: blocks of words, drawn by shard, through per-source index permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microflow.llm.common import WORD, col, free, partitions, table, written

#: Rounds of the index permutations.
ROUNDS = 40


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source (key column `source`, null last): sid, source_size, target.

    The sources share `share` of all sizes by weight; none gets more than `most` times its size, and what is over goes
    to the others by weight. Filled in closed form: in order of limit per weight, the level that the rest could share
    is compared with each limit.
    """
    every = Window.partitionBy(F.lit(0))
    by = every.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by) - 1).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w")).withColumn("all", share * F.sum("source_size").over(every))
    fill = every.orderBy("ratio", "sid")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every)["level"]
    # no such level: every source stops at its limit
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))))
    return s.select("source", "sid", F.col("source_size").cast("long").alias("source_size"), "target")


def permuted(index: str, size: str, key: str) -> str:
    """SQL of a keyed permutation of 0 to size - 1, for any size: a swap-or-not network of ROUNDS rounds.

    A round pairs x with (k - x) modulo size and swaps a pair if a bit drawn for it says so; k and the bit depend on
    the key and the round. No step leaves the range, so nothing overflows or has to be drawn again.
    """
    k = f"pmod(xxhash64({key}, r), {size})"
    partner = f"pmod({k} - x, {size})"
    return f"aggregate(sequence(1, {ROUNDS}), {index}, (x, r) -> if(pmod(xxhash64({key}, r, greatest(x, {partner})), 2) = 0, x, {partner}))"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 1024, shard_blocks: int = 4096, seed: int = 7, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, row_col: str | None = None, draw: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of a mix.

    documents: row, id, size (words), sid, source_size, target. pieces: (sid, block, row, at, lo, hi): words lo to hi of the
    block are the document's, from its word number `at` on. slots: (shard, sid, slot, round, block, words): the block that each slot of the output
    holds, and how many of its first words it takes (all but for a source's last slot, which ends at the target).

    A source's words, its documents in a seeded order, are cut into blocks of `block` words. The output's shards draw
    their source counts: each place of a source falls to a uniform shard, so the counts are multinomial, given that the
    totals meet the targets (`drawn`). A source's slots are numbered shard by shard from these counts and mapped through the
    source's permutation of its full blocks, another one each round; a short last block ends a round. A round that the target
    asks for in part deals the permutation out to its slots in even stretches, and a slot's shard and place in it choose within
    the stretch, so another draw (`draw`, else `seed`) takes other blocks of that round, never one twice. Null text and text without words have size 0 and no piece; null sources are one source, the last; rows repeating an id are
    documents of their own (`row` tells them apart). Empty tables give empty results.
    """
    number = col(row_col) if row_col else F.monotonically_increasing_id()
    sized = docs.select(number.alias("row"), col(id_col).alias("id"), col(source_col).alias("source"), col(text_col).alias("text"))
    sized = sized.select("row", "id", "source", F.expr(f"cast(regexp_count(coalesce(text, ''), r'{WORD}') as bigint)").alias("size"))
    sized = written(sized, "mix-sizes")
    t = written(targets(sized, weights, share, most), "mix-targets")
    rows = sized.join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("row", "id", "size", "sid", "source_size", "target")
    salts = max(64, sized.count() // 20_000)
    salted = rows.where("size > 0").withColumn("salt", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(salts)))
    # prefix sums in two steps, so that no task holds a whole source
    sums = salted.groupBy("sid", "salt").agg(F.sum("size").alias("s"))
    bases = sums.select("sid", "salt", (F.sum("s").over(Window.partitionBy("sid").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("base"))
    inside = Window.partitionBy("sid", "salt").orderBy("id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = salted.withColumn("off", F.sum("size").over(inside) - F.col("size")).join(bases, ["sid", "salt"]).withColumn("off", F.col("off") + F.col("base"))
    pieces = placed.select("sid", "row", "off", "size", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")).alias("block"))
    start = F.col("off") - F.col("block") * block
    pieces = pieces.select("sid", "block", "row", F.greatest(-start, F.lit(0)).alias("at"), F.greatest(start, F.lit(0)).alias("lo"), F.least(start + F.col("size"), F.lit(block)).alias("hi"))

    # whole rounds over a source's words, then as much of one more as the target asks for
    s = t.where("source_size > 0").select("sid", "source_size", F.round("target").cast("long").alias("want"), F.expr(f"source_size div {block}").alias("full"), F.expr(f"(source_size + {block} - 1) div {block}").alias("blocks"))
    s = s.withColumn("n", F.expr(f"(want div source_size) * blocks + (want % source_size + {block} - 1) div {block}"))
    total = s.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    draw = seed if draw is None else draw
    counts = shard_counts(s, shards, draw)
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n_slots").over(before), F.lit(0).cast("long")))
    # a slot a row: a hot source's shards are dealt to many tasks, whose number is set as few bytes become many rows
    slots = counts.join(s, "sid").repartition(partitions(docs.sparkSession), "sid", "shard").select("*", F.explode(F.expr("sequence(first, first + n_slots - 1)")).alias("slot"))
    slots = slots.withColumn("round", F.expr("slot div blocks")).withColumn("i", F.expr("slot % blocks"))
    # the last round's m slots: slot i has the i-th of m even stretches of the full blocks, all of them if the short block is among the m
    m = f"((want % source_size + {block} - 1) div {block})"
    least, past = (f"cast({x} as decimal(19, 0)) * cast(full as decimal(19, 0)) div {m}" for x in ("i", "(i + 1)"))  # the product may exceed a long
    chosen = f"{least} + pmod(xxhash64({draw + 3}, sid, shard, slot - first), {past} - ({least}))"
    slots = slots.withColumn("at", F.expr(f"if(round < want div source_size or {m} > full, i, {chosen})"))
    slots = slots.withColumn("block", F.when(F.col("i") < F.col("full"), F.expr(permuted("at", "full", f"{seed + 1}, sid, round"))).otherwise(F.col("i")))
    left = F.when(F.expr("round < want div source_size"), F.lit(block)).otherwise(F.expr("want % source_size") - F.col("i") * block)
    slots = slots.withColumn("words", F.least(F.lit(block), F.expr(f"source_size - block * {block}"), left))
    return rows, pieces, slots.select("shard", "sid", "slot", "round", "block", "words")


def shard_counts(sources: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """(sid, shard, n_slots): each source's n slots thrown into uniform shards, a multinomial draw a source.

    sources: sid, n. The draws of a hot source are made in many tasks and added up before they are shuffled.
    """
    chunk = 4096
    draws = sources.where("n > 0").select("sid", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")).alias("c")).repartition(partitions(sources.sparkSession), "sid", "c")
    draws = draws.select("sid", F.explode(F.expr(f"sequence(c * {chunk}, least((c + 1) * {chunk}, n) - 1)")).alias("place"))
    return draws.groupBy("sid", F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "place"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("n_slots"))


def taken(rows: DataFrame, pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """rows with `taken`, the words that the mix takes of each document, repeats counted."""
    overlap = F.greatest(F.least("hi", "words") - F.col("lo"), F.lit(0))
    got = slots.hint("merge").join(pieces, ["sid", "block"]).groupBy("row").agg(F.sum(overlap).alias("taken"))
    return rows.join(got, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """The documents of the mix: a row for each round that takes words of a document, all columns kept.

    A round that takes all words gives the text as it is, any other the words taken, joined by single spaces; then
    length_col, if given, becomes the new text's count of code points. Documents that are not drawn have no row.
    """
    own, parts, words, cut_ = (free(x, docs) for x in ("mix_row", "mix_parts", "mix_words", "mix_cut"))
    numbered = written(docs.withColumn(own, F.monotonically_increasing_id()), "mix-documents")
    rows, pieces, slots = mix(numbered, text_col=text_col, row_col=own, **options)
    n = F.least("hi", "words") - F.col("lo")
    got = slots.hint("merge").join(pieces, ["sid", "block"]).where(n > 0).groupBy("row", "round").agg(F.sum(n).alias("n"), F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), n.cast("int").alias("n")))).alias("parts"))
    got = got.join(rows.select("row", "size"), "row")
    got = got.select(F.col("row").alias(own), F.when(F.col("n") < F.col("size"), F.col("parts")).alias(parts))
    out = numbered.join(got, own)
    found = F.regexp_extract_all(col(text_col), F.lit(WORD), F.lit(0))
    # an array argument is computed once, whatever the number of parts
    cut = F.expr(f"aggregate({parts}, struct({words} as w, '' as t), (a, x) -> struct(a.w as w, concat(a.t, if(a.t = '', '', ' '), array_join(slice(a.w, x.at + 1, x.n), ' ')) as t), a -> a.t)")
    out = out.withColumn(words, F.when(F.col(parts).isNotNull(), found)).withColumn(cut_, cut)
    changed = {text_col: F.coalesce(F.col(cut_), col(text_col))}
    if length_col:
        changed[length_col] = F.when(F.col(cut_).isNotNull(), F.length(cut_)).otherwise(col(length_col)).cast(docs.schema[length_col].dataType)
    return out.withColumns(changed).select(*[col(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(*mix(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
