"""Personal data by patterns, and by contexts learnt from them, in DataFrame operations only.

Base kinds are found by regular expressions, and so are secrets (access keys, and values labelled as passwords or
tokens). Bootstrapped contextual extraction then takes what they found as seeds. The words beside seeds become lexical
patterns: a label before the value (`mail: `, `card="`, `token = "`), the word before it, the word after it. Patterns and
the values they enclose form a graph, and scores run over it: a pattern is as good as what it encloses, counted over all
of the corpus, is known; a value is as good as its patterns. Values of good patterns are found as further identifiers,
and serve as seeds of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import read, written

#: Kinds in the order of the result. Quantifiers are possessive, so that long runs cost no backtracking or stack.
BASE = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
#: Seeds that are no base kind; the group is the span.
SECRETS = [
    r"""(?i)(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?[\x20\t]*+[=:][\x20\t]*+["']?((?=[A-Za-z_./+~!@$%^&*-]*+[0-9])[A-Za-z0-9_./+~!@$%^&*-]{8,})""",
    r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
]
#: Values that a context may identify: numbers in groups, or runs of letters, digits and joining marks with a digit or @.
VALUE = r"(?<![A-Za-z0-9])(\(?[0-9][0-9\x20().-]{5,}[0-9](?![A-Za-z0-9])|(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9][A-Za-z0-9._%+@/-]{4,}[A-Za-z0-9])"
#: What the kinds are called, by number.
NAMES = [*(k for k, _ in BASE), "secret", "found"]
SECRET, FOUND = len(BASE), len(BASE) + 1
_MARKS, _OPEN = r"[=:#]", r"""[=:#"'(<\[{]"""
#: Rounds of scoring; score from which patterns count, and values are found; different seeds that a pattern needs.
ROUNDS, CONFIDENCE, SEEDS = 3, 0.8, 4
#: A value with one pattern that makes up more than one in so many of all occurrences is looked up by broadcast.
HOT = 1000


def _found(number: int, text: Column, pattern: str, when: Column, group: int = 0) -> Column:
    """Matches of a pattern: how far each begins after the one before it, its length, its text (of the group, which ends the
    match), the last words before it and the first word after it."""
    none = F.array().cast("array<string>")
    gaps = F.when(when, F.split(text, pattern, -1)).otherwise(none)
    hits = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)
    whole = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none) if group else hits
    last = lambda g: F.reverse(F.regexp_extract(F.reverse(g), r"^\S*+\s*+\S*+\s*+\S*+", 0))
    before = F.transform(gaps, lambda g: F.struct(F.char_length(g).alias("skip"), last(g).alias("left"), F.regexp_extract(g, r"""^["')>\]}.,;]*+\s++(\S++)""", 1).alias("head")))
    after = F.transform(F.slice(before, 2, F.size(before)), lambda g: g["head"])
    rows = F.arrays_zip(before.alias("gap"), after.alias("right"), hits.alias("hit"), F.transform(whole, lambda h: F.char_length(h)).alias("size"), F.transform(whole, lambda h: h).alias("whole"))
    return F.struct(F.lit(number).alias("number"), rows.alias("rows"))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(number: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.char_length(digits)
    small = F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    checked = F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    return F.when(number == 1, small).when(number == 2, checked).when(number == 3, n.between(9, 15)).otherwise(True)


def matches(texts: DataFrame) -> DataFrame:
    """(id, sig, number, start, end, hit, left, right) for every match in texts (id, sig, text): base kinds, secrets, and
    values (numbered FOUND) that a context may identify; code points, end exclusive."""
    text = F.col("text")
    needs = {"email": "@", "phone": "+"}
    kinds = [_found(i, text, p, F.contains(text, F.lit(needs.get(k, "")))) for i, (k, p) in enumerate(BASE)]
    kinds += [_found(SECRET, text, p, F.lit(True), 1) for p in SECRETS]
    kinds.append(_found(FOUND, text, VALUE, F.lit(True)))
    rows = texts.select("id", "sig", F.posexplode(F.array(*kinds)).alias("list", "k"))
    rows = rows.select("id", "sig", "list", "k.number", F.posexplode("k.rows").alias("pos", "row")).filter(F.col("row.hit").isNotNull())
    run = W.partitionBy("id", "sig", "list").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("row.gap.skip") + F.col("row.size")).over(run)
    lead = F.when(F.col("number") == SECRET, F.concat("row.gap.left", F.substr("row.whole", F.lit(1), F.col("row.size") - F.char_length("row.hit")))).otherwise(F.col("row.gap.left"))
    out = rows.select("id", "sig", "number", F.col("row.hit").alias("hit"), lead.alias("left"), F.coalesce("row.right", F.lit("")).alias("right"), end.alias("end"))
    return out.withColumn("start", F.col("end") - F.char_length("hit")).filter(_valid(F.col("number"), F.col("hit"))).dropDuplicates(["id", "sig", "number", "start", "end"])


def _free(found: DataFrame, fixed: Column) -> DataFrame:
    """The rows that are fixed, and others that overlap none of them in their text. Both frames grow with the rows."""
    ahead = W.partitionBy("id", "sig").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy("id", "sig").orderBy(F.desc("start"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    marked = found.withColumn("_fixed", fixed)
    marked = marked.withColumn("_upto", F.max(F.when(F.col("_fixed"), F.col("end"))).over(ahead)).withColumn("_next", F.min(F.when(F.col("_fixed"), F.col("start"))).over(back))
    apart = (F.coalesce("_upto", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True))
    return marked.filter(F.col("_fixed") | apart).drop("_fixed", "_upto", "_next")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns beside a value: a label or the word before it, and the word after it; none where there is none.

    An attached label (`password=`) is named a, a word with a mark l, a word and a mark apart from it b, a plain word w,
    and the word after the value r.
    """
    parts = F.split(F.lower(left), r"\s+")
    word = lambda k: F.coalesce(F.get(parts, F.size(parts) - k), F.lit(""))
    own, one, two = word(1), word(2), word(3)
    before = F.when(own.rlike(rf"[a-z0-9].*{_OPEN}$"), F.concat(F.lit("a "), own))
    before = before.when((own != "") & ~own.rlike(rf"^{_OPEN}+$"), None).when(one.rlike(rf"^{_MARKS}+$") & (two != ""), F.concat_ws(" ", F.lit("b"), two, one))
    before = before.when(one.rlike(f"{_MARKS}$"), F.concat(F.lit("l "), one)).when(one != "", F.concat(F.lit("w "), one))
    return F.array_compact(F.array(before, F.when(right != "", F.concat(F.lit("r "), F.lower(right)))))


def pattern_totals(texts: DataFrame) -> DataFrame:
    """(pattern, total): how often each word or label stands in all texts, whatever is beside it, as l, w, r, a and b patterns
    name it; l, w and r are counted once, under w."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
    attached = F.transform(F.filter(words, lambda t: t.rlike(rf"[a-z0-9].*{_OPEN}.")), lambda t: F.concat(F.lit("a "), F.regexp_extract(t, rf"^.*{_OPEN}", 0)))
    apart = F.regexp_extract_all(F.lower("text"), F.lit(rf"\S++\s++{_MARKS}++(?=\s)"), F.lit(0))
    apart = F.transform(apart, lambda t: F.concat(F.lit("b "), F.regexp_replace(t, r"\s+", " ")))
    units = F.concat(F.transform(words, lambda t: F.concat(F.lit("w "), t)), attached, apart)
    return texts.select(F.explode(units).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """Scores the graph of (pattern, value, seed, n, total) and returns (pattern, value) where a good pattern encloses a value
    that is no seed. n: occurrences of both; total: those of the pattern with anything.

    Pattern score: sum of n times its values' scores over total; it counts from `confidence` and `seeds` different good
    values on. Value score: 1 for seeds, else 1 - product(1 - score) over the patterns that have so many good values.
    """

    def scored(values: DataFrame) -> DataFrame:
        joined = edges.drop("seed").join(values, "value")
        n = F.sum("n")
        out = joined.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.greatest(F.max("total"), n)).alias("strength"), F.count_if(F.col("score") >= confidence).alias("known"))
        return out.filter(F.col("known") >= seeds)

    values = edges.groupBy("value").agg(F.max("seed").alias("seed"), F.max("seed").cast("double").alias("score"))
    for _ in range(rounds):
        reach = edges.select("pattern", "value").join(scored(values), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.ln(1 - F.least("strength", F.lit(0.999)))))).alias("reached"))
        values = values.join(reach, "value", "left").select("value", "seed", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score"))
        values = written(values, "values")
    strong = scored(values).filter(F.col("strength") >= confidence).select("pattern")
    fresh = values.filter((F.col("seed") == 0) & (F.col("score") >= confidence)).select("value")
    return edges.select("pattern", "value").join(strong, "pattern", "left_semi").join(fresh, "value", "left_semi").select("pattern", "value")


def _chosen(occurrences: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Occurrences whose (pattern, value) is chosen. Pairs with more than a HOT-th of all occurrences, fewer than HOT of
    them, are broadcast, so that no task gets all occurrences of one."""
    key = ["pattern", "value"]
    total = edges.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(edges.filter(F.col("n") * HOT > total).select(*key))
    many = occurrences.join(hot, key, "left_semi").join(F.broadcast(edges.filter(F.col("n") * HOT > total).select(*key).join(chosen, key, "left_semi")), key, "left_semi")
    return many.unionByName(occurrences.join(hot, key, "left_anti").join(chosen, key, "left_semi"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone, n_secret, n_found, n_spans, base_sha256, spans.

    spans lists kind:start:end by kind (email, ip, card, phone, then the method's own: secret and found), then start; code
    points, end exclusive. Base spans are those of the patterns that pass their checks; the method's own never overlap
    them. n_spans counts all.

    A value is looked for whatever its length; its context is what stands between the value before it and the one after
    it. Null and empty texts have none. Rows that repeat an id are told apart by their text; equal rows give equal
    results. Null ids are kept. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("sig", F.xxhash64("text"))
    likely = rows.filter(F.col("text").rlike("[0-9@]")).dropDuplicates(["id", "sig"])
    found = written(_free(matches(likely), F.col("number") < SECRET), "matches")
    known = found.filter(F.col("number") < FOUND)
    values = _free(found, F.col("number") < FOUND).filter(F.col("number") == FOUND)
    beside = known.withColumn("seed", F.lit(1)).unionByName(values.withColumn("seed", F.lit(0)))
    beside = beside.select("id", "sig", "start", "end", "seed", F.md5(F.lower("hit")).alias("value"), F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern"))
    counts = written(beside.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "contexts")
    unit = F.when(F.col("pattern").rlike("^[lr] "), F.concat(F.lit("w"), F.substr("pattern", F.lit(2)))).otherwise(F.col("pattern"))
    asked = counts.groupBy("pattern").agg(F.sum("seed").alias("seeds")).filter(F.col("seeds") >= seeds).select("pattern", unit.alias("unit"))
    totals = asked.join(pattern_totals(rows.select("text")).withColumnRenamed("pattern", "unit"), "unit", "left").select("pattern", "total")
    edges = written(counts.join(totals, "pattern").withColumn("total", F.coalesce("total", F.lit(0))), "graph")
    chosen = bootstrap(edges, rounds, confidence, seeds)
    new = _chosen(beside.filter("seed = 0"), edges, chosen).select("id", "sig", F.lit(FOUND).alias("number"), "start", "end").distinct()
    spans = known.select("id", "sig", "number", "start", "end").unionByName(new)
    names = F.array(*map(F.lit, NAMES))
    listed = spans.groupBy("id", "sig").agg(F.sort_array(F.collect_list(F.struct("number", "start", "end"))).alias("s"))
    joined = rows.select(F.col("id"), "sig").alias("d").join(listed.alias("l"), F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.sig") == F.col("l.sig")), "left")
    everything = F.coalesce(F.col("l.s"), F.array().cast("array<struct<number:int,start:bigint,end:bigint>>"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["number"]), x["start"], x["end"])), ",")
    count = lambda i: F.size(F.filter("s", lambda x: x["number"] == i)).cast("bigint")
    out = joined.select(F.col("d.id").alias("id"), everything.alias("s"))
    return out.select(F.col("id").alias(id_col), *(count(i).alias(f"n_{k}") for i, k in enumerate(NAMES)), F.size("s").cast("bigint").alias("n_spans"), F.sha2(text(F.filter("s", lambda x: x["number"] < SECRET)), 256).alias("base_sha256"), text(F.col("s")).alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))
