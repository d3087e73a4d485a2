"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.llm.common import col, drop, free, table, written

#: Lines to fetch by broadcast at most; more are fetched by a shuffled join.
BROADCAST_LINES = 2_000_000
_PLACES = "10000000000"
#: Letters that are counted to tell lines apart; which ones changes the speed only, not the result.
LETTERS = "eaionrstlhdcumfp"


def _start(i: int | str, length: str, parts: int) -> str:
    """Where the i-th (from 0) of `parts` segments of a line of some length starts; the last ones are longer."""
    return f"({i} * ({length} div {parts}) + greatest({i} - {parts} + {length} % {parts}, 0))"


def _size(i: int | str, length: str, parts: int) -> str:
    return f"(({length} div {parts}) + if({i} >= {parts} - {length} % {parts}, 1, 0))"


def segments(errors: int) -> str:
    """The index entries of a line: a key for each of its errors + 1 segments."""
    parts = errors + 1
    return ", ".join(f"xxhash64({i}, n, substring(line, {_start(i, 'n', parts)} + 1, {_size(i, 'n', parts)}))" for i in range(parts))


def probes(errors: int) -> str:
    """The places where a line looks for lines that are shorter by 0 to `errors`: an array of structs for `probe_key`.

    If the i-th segment is the first to match, the parts before it have i errors at most (from 0) and those after it
    errors - i, which bounds how far it can have moved.
    """
    out = []
    for less in range(errors + 1):
        for i in range(errors + 1):
            for move in range(max(-i, less - (errors - i)), min(i, less + errors - i) + 1):
                out.append(f"struct({i} as i, {less} as less, {move} as move)")
    return f"array({', '.join(out)})"


def probe_key(errors: int) -> str:
    """The key of place p of `probes` in a line of n characters.

    One expression for all places: one for each made a method too long for the JVM to compile. A line of ASCII is cut as
    bytes, where no characters need counting; the hash is the same.
    """
    parts, n = errors + 1, "(n - p.less)"
    start, size = f"{_start('p.i', n, parts)} + p.move + 1", _size("p.i", n, parts)
    piece = f"if(n = octet_length(line), substring(cast(line as binary), {start}, {size}), cast(substring(line, {start}, {size}) as binary))"
    return f"xxhash64(p.i, {n}, {piece})"


def _once(expr: str, name: str):
    """A column of its own, computed once: explode keeps it so, a projection would be computed anew wherever it is used."""
    return F.explode(F.array(F.expr(expr))).alias(name)


def within(pairs: DataFrame, errors: int) -> DataFrame:
    """The pairs (a, b, x, y) whose texts are within an edit distance, by a banded automaton of 2 * errors + 1 diagonals.

    Bit d + errors of row e: so much of x as was read becomes, with e errors at most, a beginning of y that is d
    characters longer. A character of x moves all diagonals of all rows at once; its mask has a bit for each diagonal on
    which it equals y's character.
    """
    full = (1 << 2 * errors + 1) - 1
    rows = pairs.select("a", "b", _once("struct(regexp_extract_all(x, '(?s).', 0) as x, regexp_extract_all(y, '(?s).', 0) as y)", "t")).select("a", "b", "t.x", "t.y")
    mask = " + ".join(f"if(c <=> get(y, i + {d}), {1 << (d + errors)}, 0)" for d in range(-errors, errors + 1))
    first = ", ".join(f"{sum(1 << (errors + d) for d in range(e + 1))} as r{e}" for e in range(errors + 1))
    # a row needs the new bits of the row before: these are spelled out in terms of the old rows
    new = ["(s.r0 & m)"]
    for e in range(1, errors + 1):
        new.append(f"(((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | shiftleft({new[e - 1]}, 1)) & {full})")
    state = ", ".join(f"{x} as r{e}" for e, x in enumerate(new))
    # once the last row is empty it stays so
    last = f"aggregate(transform(x, (c, i) -> {mask}), struct({first}), (s, m) -> if(s.r{errors} = 0, s, struct({state})), s -> s.r{errors})"
    return rows.where(F.expr(f"({last} & shiftleft(1, size(y) - size(x) + {errors})) <> 0")).select("a", "b")


def _common(a: str, b: str, piece: str) -> str:
    """How many characters two texts share at one end: halving steps; piece: SQL of the n characters at that end of {x}."""
    same = piece.format(x=a, n="k + step") + " = " + piece.format(x=b, n="k + step")
    return f"aggregate(transform(sequence(0, 30), i -> shiftleft(1, 30 - i)), 0, (k, step) -> if(k + step <= least(length({a}), length({b})) and {same}, k + step, k))"


def similar(pairs: DataFrame, errors: int) -> DataFrame:
    """The pairs (a, b, x, y) whose texts x and y are within the edit distance; what they share at both ends is cut off first."""
    rows = pairs.select("a", "b", "x", "y", _once(_common("x", "y", "left({x}, {n})"), "p"))
    rows = rows.select("a", "b", _once("struct(substring(x, p + 1) as x, substring(y, p + 1) as y)", "t")).select("a", "b", F.col("t.x").alias("u"), F.col("t.y").alias("v"))
    rows = rows.select("a", "b", "u", "v", _once(_common("u", "v", "right({x}, {n})"), "q"))
    rows = rows.select("a", "b", _once("struct(left(u, length(u) - q) as x, left(v, length(v) - q) as y)", "t")).select("a", "b", "t.x", "t.y")
    return within(rows, errors)


def sketch(line: str) -> str:
    """A long whose bits tell most lines apart that aren't within a few edits: words above, letters below.

    Words: 32 parities of hashed words; an edit changes three words at most, two gone and one new or the other way
    round. Letters: 2 bits a letter of LETTERS, its count modulo 4 in Gray code, so that counts one apart differ in one
    bit; an edit changes two counts by one.
    """
    words = f"aggregate(split({line}, ' '), 0L, (s, w) -> s ^ shiftleft(1L, cast(pmod(xxhash64(w), 32) as int) + 32))"
    counts = (f"(octet_length({line}) - octet_length(replace({line}, '{letter}', ''))) & 3" for letter in LETTERS)
    return " | ".join([words, *(f"cast(shiftright({0b10110100}, 2 * ({n})) & 3 as bigint) << {2 * i}" for i, n in enumerate(counts))])


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no, line) of every line; equal rows give equal lines."""
    base = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    return base.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("no", "line"))


def _place(id_: str = "id", no: str = "no"):
    return F.expr(f"cast(coalesce(cast({id_} as decimal(38,0)), 9223372036854775808) * {_PLACES} + {no} as decimal(38,0))")


def _among(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` is in ids, a written table."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_LINES else ids, on, "left_semi")


def meeting(lines: DataFrame, errors: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """The index entries and the probes, (lid, n, key) each, that share a key with one of another line; written tables.

    By a semi-join, so an entry that shares its key with many others is one row still.
    """
    long = lines.select("lid", "line", F.length("line").alias("n")).where(F.col("n") >= min_chars)
    index = long.select("lid", "n", F.expr(f"explode(array({segments(errors)}))").alias("key"))
    # shorter partners may be under min_chars, where nothing is indexed
    probe = long.select("lid", "n", "line", F.expr(f"explode({probes(errors)})").alias("p")).select("lid", "n", F.expr(probe_key(errors)).alias("key"))
    own = index.select("key", F.col("lid").alias("a"))
    probed = written(probe.join(own, (probe.key == own.key) & (probe.lid != own.a), "left_semi"), "line-probed")
    keys = written(probed.select("key").distinct(), "line-keys")
    indexed = written(_among(index, keys, "key"), "line-indexed")
    drop(keys)
    return indexed, probed


def near_pairs(lines: DataFrame, errors: int, min_chars: int) -> DataFrame:
    """(a, b): all pairs of different lines within the edit distance, as structs of their names.

    lines: lid, lid2, line, of distinct texts. Lines meet by lid, whatever shares it; the texts decide. Only lines that
    share a key with another one are sketched.
    """
    indexed, probed = meeting(lines, errors, min_chars)
    met = written(indexed.select("lid").unionByName(probed.select("lid")).distinct(), "line-met")
    sketched = written(_among(lines.select("lid", "lid2", "line"), met, "lid").select("lid", "lid2", "line", F.expr(sketch("line")).alias("sketch")), "line-sketches")
    drop(met)
    bits = sketched.select("lid", "sketch")
    a = indexed.join(bits, "lid").select("key", F.col("lid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = probed.join(bits, "lid").select("key", F.col("lid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    # of two lines of one length only one order counts
    met = a.join(b, (a.key == b.key) & (F.col("nb") - F.col("na")).between(0, errors) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b"))) & F.expr(f"bit_count(shiftrightunsigned(sa ^ sb, 32)) <= {3 * errors} and bit_count((sa ^ sb) & 4294967295) <= {2 * errors}"))
    pairs = written(met.select("a", "b").distinct(), "line-candidates")
    drop(indexed, probed)
    wanted = written(pairs.select(F.col("a").alias("lid")).unionByName(pairs.select(F.col("b").alias("lid"))).distinct(), "line-wanted")
    texts = written(_among(sketched.select("lid", F.struct("lid", "lid2").alias("name"), "line"), wanted, "lid"), "line-texts")
    drop(sketched)
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("name").alias("one"), F.col("line").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("name").alias("two"), F.col("line").alias("y")), "b")
    out = written(similar(both.select(F.col("one").alias("a"), F.col("two").alias("b"), "x", "y"), errors), "line-pairs")
    drop(pairs, wanted, texts)
    return out


def dropped_lines(docs: DataFrame, errors: int = 2, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, th (hash of the text), n_lines, n_exact and n_near (lines dropped), dropped (their numbers from 0).

    A line is dropped if an equal line, or one within `errors` edits, stands earlier: in a document of smaller id or
    earlier in its own; lines are judged on the input. Lines under min_chars code points have only exact copies; blank
    lines (no character but ASCII white space) are never dropped. A null text is one empty line. Null ids come last.
    Rows that repeat an id and text are one document; rows that repeat an id alone interleave by line number. Other
    columns are ignored; an empty table gives an empty result. Equal lines are found by two independent 64-bit hashes.

    Each line of n characters is cut into errors + 1 segments, one of which a partner within `errors` edits has
    unchanged and hardly moved. Segments are indexed by number, line length and text; every line probes the lengths up
    to its own. Lines that meet another one are sketched; pairs whose words' sketch and letters' counts allow it are
    verified by a bit-parallel band.
    """
    lines = _lines(docs, id_col, text_col)
    filled = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    name, other = F.xxhash64("line").alias("lid"), F.xxhash64(F.lit(2), "line").alias("lid2")
    distinct = filled.groupBy("line").agg(F.count("*").alias("times"), F.min(_place()).alias("first")).select(name, other, "line", "times", "first")
    distinct = written(distinct, "lines")
    pairs = near_pairs(distinct, errors, min_chars)
    firsts = distinct.select("lid", "lid2", "first")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.select(F.col("a.lid").alias("a"), F.col("a.lid2").alias("a2"), F.col("b.lid").alias("lid"), F.col("b.lid2").alias("lid2"))
    near = both.join(firsts, ["lid", "lid2"]).groupBy(F.col("a").alias("lid"), F.col("a2").alias("lid2")).agg(F.min("first").alias("near"))
    # lines that occur once and have no partner are never dropped; their places need no shuffle
    known = distinct.select("lid", "lid2", "times", "first").join(near, ["lid", "lid2"], "left").where("times > 1 or near is not null").select("lid", "lid2", "first", "near")
    known = written(known, "line-known")
    places = _among(filled.select("id", "th", "no", name, other), known.select("lid"), "lid").distinct()
    gone = places.join(known, ["lid", "lid2"]).withColumn("place", _place()).where("place > first or place > near")
    gone = gone.groupBy("id", "th").agg(F.count(F.when(F.col("place") > F.col("first"), 1)).alias("n_exact"), F.count("*").alias("n"), F.array_sort(F.collect_list("no")).alias("dropped"))
    rows = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("th"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    r, g = rows.alias("r"), gone.alias("g")
    out = r.join(g, F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.th") == F.col("g.th")), "left")
    exact = F.coalesce("n_exact", F.lit(0))
    return out.select(F.col("r.id").alias(id_col), F.col("r.th").alias("th"), "n_lines", exact.alias("n_exact"), (F.coalesce("n", F.lit(0)) - exact).alias("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(docs: DataFrame, errors: int = 2, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of their texts; all columns and rows stay, whatever the columns' names.

    A text without dropped lines stays as it is, null included; one that loses all its lines becomes empty.
    """
    i, t, d = (free(x, docs) for x in ("found_id", "found_text", "found_lines"))
    named = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    found = dropped_lines(named, errors, min_chars, "id", "text").where("size(dropped) > 0").select(F.col("id").alias(i), F.col("th").alias(t), F.col("dropped").alias(d)).dropDuplicates([i, t])
    text = F.coalesce(col(text_col), F.lit(""))
    joined = docs.join(found, col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(t)), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, k: ~F.array_contains(d, k)), "\n")
    return joined.withColumn(text_col, F.when(F.col(d).isNotNull(), kept).otherwise(col(text_col))).select(*[col(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(table(spark, sf_dir, "documents")).drop("th")
