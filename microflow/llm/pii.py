"""Personal data: exact base patterns, and bootstrapped contextual extraction of what they miss. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microflow.llm.common import col, drop, free, table, written

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. What repeats can't give back what it took without failing at once, so it is possessive, and
# matches begin only where a run of the first class does: both keep long texts linear and the matches the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Groups of digits that single spaces join, with nothing but punctuation around them.
_GROUPS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@A-Za-z]{0,3}+[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+)*+(?![^\x20\x09-\x0D,;:!?\x22\x27\]}>])"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]+', '')"


def _luhn(digits: str) -> str:
    """Whether a text of digits passes the check sum: from the right, every second digit counts doubled."""
    one = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + if(i % 2 = 0, {one}, 2 * {one} - if({one} > 4, 9, 0))) % 10 = 0"


def _valid(kind: str, x: str) -> str:
    if kind == "ip":
        return f"{x} rlike '^{_PART}(?:[.]{_PART}){{3}}$'"
    if kind == "card":
        return f"if(length({_digits(x)}) between 12 and 19, {_luhn(_digits(x))}, false)"
    if kind == "phone":
        return f"length({_digits(x)}) between 9 and 15"
    return "true"


#: kind: (pattern, what a text must have for it to be worth searching)
_BASE = {"email": (EMAIL, "contains(text, '@')"), "ip": (IP, r"text rlike r'[0-9]\.[0-9]'"), "card": (CARD, r"text rlike r'[0-9](?:[\x20-]?[0-9]){11}'"), "phone": (PHONE, "contains(text, '+')")}


def base_spans(kind: str):
    """array<struct<s, k, e>> of a kind's valid matches in `text`, in code points; k: the kind's place in KINDS."""
    pattern, needs = _BASE[kind]
    k = KINDS.index(kind)
    empty = "cast(array() as array<struct<s:int,k:int,e:int>>)"
    # what stands between matches and the matches, side by side: their lengths add up to places
    zipped = f"arrays_zip(split(text, {_sql(pattern)}, -1), regexp_extract_all(text, {_sql(pattern)}, 0))"
    parts = f"transform({zipped}, x -> struct(length(x.`0`) as g, coalesce(length(x.`1`), 0) as m, coalesce({_valid(kind, 'x.`1`')}, false) and x.`1` is not null as ok))"
    step = "struct(a.at + x.g + x.m as at, if(x.ok, concat(a.found, array(struct(a.at + x.g as s, %d as k, a.at + x.g + x.m as e))), a.found) as found)" % k
    return F.expr(f"if({needs}, aggregate({parts}, struct(0 as at, {empty} as found), (a, x) -> {step}, a -> a.found), {empty})")


def _units(docs: DataFrame) -> DataFrame:
    """What may be an identifier, (id, th, s, e, value, label, l1, l2, r1): groups of digits and tokens with a digit or @.

    label: the kind of the longest base span within it. l1, l2, r1: the last word, the last two and the next one around it, lowered,
    digits as 9.
    """
    unit = _sql(f"(?:{_GROUPS})|(?:{_TOKEN})")
    base = F.array_sort(F.concat(*[base_spans(kind) for kind in KINDS])).alias("base")
    parts = docs.where("text rlike '[0-9@]'").select("id", "th", base, F.expr(f"split(text, {unit}, -1)").alias("g"), F.expr(f"regexp_extract_all(text, {unit}, 0)").alias("m"))
    space, letter = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    word = lambda c, p: f"regexp_replace(lower(regexp_extract({c}, r'{p}', 1)), '[0-9]', '9')"
    last = word("x.g", f"(?<!{letter})({letter}++){space}*+$")
    two = word("x.g", f"(?<!{letter})({letter}++{space}++{letter}++){space}*+$")
    after = word("x.`2`", f"^{space}*+({letter}++)")
    rows = parts.select("id", "th", "base", F.expr(f"posexplode(transform(arrays_zip(g, m, slice(g, 2, size(g))), x -> struct(length(x.g) as gap, x.m as m, {last} as l1, {two} as l2, {after} as r1)))").alias("i", "x"))
    rows = rows.select("id", "th", "base", "i", "x.*").where("m is not null")
    own = Window.partitionBy("id", "th").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # punctuation around a unit isn't part of it, nor are brackets that it opens or closes alone
    lead = F.expr(r"""length(regexp_extract(m, r'^(?:["\x27<\[{,;:]|\((?![^)]*\)))*', 0))""")
    value = F.expr(r"""regexp_replace(m, if(contains(m, '('), r'^(?:["\x27<\[{,;:]|\((?![^)]*\)))+|["\x27>\]},;:.!?]+$', r'^["\x27<\[{,;:]+|["\x27)>\]},;:.!?]+$'), '')""")
    rows = rows.distinct().withColumn("e0", F.sum(F.col("gap") + F.length("m")).over(own).cast("int"))
    rows = rows.withColumn("value", value).withColumn("s", F.col("e0") - F.length("m") + lead).withColumn("e", F.col("s") + F.length("value")).where("e > s")
    label = F.expr("-array_max(transform(filter(base, b -> b.s < e and b.e > s), b -> struct(b.e - b.s as size, -b.k as k))).k")
    return rows.select("id", "th", "s", "e", "value", label.alias("label"), "l1", "l2", "r1")


def discover(units: DataFrame, rounds: int = 3, least_seeds: int = 5, confident: float = 0.9, least_digits: int = 6) -> DataFrame:
    """(value, kind): values that the base patterns don't know, found by lexical patterns that mostly hold known ones.

    Values with a base span are the seeds. They induce patterns out of the words around them: the two words before, the word
    before with the word after, and either word with the value's coarse form (runs of letters a, of digits 9, of other
    characters -). Two patterns thus look at no form at all, so identifiers of an unknown form are found. In the graph
    of patterns and values, seeds score 1. A round gives each pattern the mean score of its values (the sum over their
    number and 1) and each unknown value its best pattern's, if that has least_seeds seeds at least. What scores
    `confident` in the end is new. Only values with least_digits digits or an @ can be.
    """
    coarse = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\p{L}+", "a"), "[0-9]+", "9"), "[^a9]+", "-")
    some = lambda kind, *parts: F.when(F.least(*[F.length(x) for x in parts], F.lit(1)) > 0, F.concat_ws(" ", F.lit(kind), *parts))
    l1, l2, r1 = F.col("l1"), F.col("l2"), F.col("r1")
    patterns = F.array_compact(F.array(some("two", l2), some("around", l1, r1), some("before", l1, coarse), some("after", r1, coarse)))
    edges = written(units.select("value", "label", F.explode(patterns).alias("pattern")).groupBy("value", "pattern").agg(F.min("label").alias("label")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seeds = edges.where("label is not null").groupBy("value").agg(F.min("label").alias("kind")).select("value", "kind", F.lit(1.0).alias("score"), F.lit(True).alias("known"))
    digits = F.length(F.regexp_replace("value", "[^0-9]+", ""))
    open_ = edges.where("label is null").where((digits >= least_digits) | F.col("value").contains("@")).select("value", "pattern")
    scores = made = seeds
    for _ in range(rounds):
        held = edges.select("value", "pattern").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count(F.when(F.col("known"), 1)).alias("seeds"))
        trusted = held.where(F.col("seeds") >= least_seeds).join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("size") + 1)).alias("trust"))
        new = open_.join(trusted, "pattern").groupBy("value", "kind").agg(F.max("trust").alias("score")).where("score >= 0.5").join(seeds.select("value"), "value", "left_anti")
        before, made = made, written(seeds.unionByName(new.select("value", "kind", "score", F.lit(False).alias("known"))), "pii-scores")
        scores = made
        drop(before)
    best = scores.where(~F.col("known") & (F.col("score") >= confident)).groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    return best.select("value", (-F.col("b.k")).alias("kind"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_seeds: int = 5, confident: float = 0.9) -> DataFrame:
    """Per row: id, th (hash of the text), base and spans (array of s, k, e: start, kind number, end in code points, end exclusive).

    base: leftmost non-overlapping valid matches of each kind's pattern; spans: these and what `discover` adds, where it
    overlaps no base span. Null and empty texts have none. Null ids are kept; rows that repeat an id and text get the
    same spans. Other columns are ignored. An empty table gives an empty result.
    """
    base = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = base.select("id", "th", F.array_sort(F.concat(*[base_spans(kind) for kind in KINDS])).alias("base"))
    found = written(found, "pii-base")
    units = written(_units(base), "pii-units")
    new = discover(units, rounds, least_seeds, confident)
    more = units.join(new, "value").groupBy("id", "th").agg(F.collect_list(F.struct("s", F.col("kind").alias("k"), "e")).alias("more"))
    r, m = found.alias("r"), more.alias("m")
    out = r.join(m, F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.th") == F.col("m.th")), "left").select("r.id", "r.th", "base", "more")
    spans = F.expr("array_sort(concat(base, filter(coalesce(more, array()), x -> not exists(base, b -> x.s < b.e and x.e > b.s))))")
    return out.select(F.col("id").alias(id_col), "th", "base", spans.alias("spans"))


def _text(spans: str):
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.s, x.e)), ',')")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with every span replaced by its kind's mark; of overlapping spans the first starting, longest one counts.

    All columns and rows stay, whatever the columns' names; texts without a span, null included, stay as they are.
    """
    i, h, sp, tx = (free(x, docs) for x in ("span_id", "span_hash", "span_list", "span_text"))
    found = find(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "id", "text").where("size(spans) > 0").select(F.col("id").alias(i), F.col("th").alias(h), F.col("spans").alias(sp)).dropDuplicates([i, h])
    text = F.coalesce(col(text_col), F.lit(""))
    joined = docs.join(found, col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h)), "left").withColumn(tx, text)
    marks = ", ".join("'" + mark.format(k).replace("'", "\\'") + "'" for k in KINDS)
    new = F.expr(f"aggregate({sp}, struct(0 as at, '' as t), (a, x) -> if(x.s < a.at, struct(a.at as at, a.t as t), struct(x.e as at, concat(a.t, substring({tx}, a.at + 1, x.s - a.at), element_at(array({marks}), x.k + 1)) as t)), a -> concat(a.t, substring({tx}, a.at + 1)))")
    return joined.withColumn(text_col, F.when(F.col(sp).isNotNull(), new).otherwise(col(text_col))).select(*[col(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_text("base").cast("binary"), 256).alias("base_sha256"), _text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
