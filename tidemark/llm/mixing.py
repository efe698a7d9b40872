"""Mixing sources to target weights down a domain-language-source tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import read, written

#: The tree's leaves are summed up on the driver; more than this is an error.
MAX_LEAVES = 100_000
#: To find where a leaf's token budget ends, seeded orders are cut in 2 ** BITS ranges, and the range that holds the end
#: again, DEPTH times in all: what is left to sort is a 2 ** -24 of the leaf.
BITS, DEPTH = 8, 3
SEED = 20240517
_WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


@dataclass
class Node:
    """A node of the tree: tokens that its leaves have, and its children by name."""

    tokens: int = 0
    children: dict[str, Node] = field(default_factory=dict)


def tree_of(leaves: list[tuple[tuple[str, ...], int]]) -> Node:
    root = Node()
    for path, tokens in leaves:
        node = root
        node.tokens += tokens
        for name in path:
            node = node.children.setdefault(name, Node())
            node.tokens += tokens
    return root


def fill(weights: list[float], limits: list[float], budget: float) -> list[float]:
    """Splits budget by weights; what a part cannot take goes to the others by their weights, until none is left over or
    all are full. Parts of no weight take nothing, so that a weight of 0 leaves a source out."""
    out = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    while open_ and budget > 1e-9:
        total = sum(weights[i] for i in open_)
        share = {i: budget * weights[i] / total for i in open_}
        full = [i for i in open_ if out[i] + share[i] >= limits[i]]
        for i in full or open_:
            taken = limits[i] - out[i] if full else share[i]
            out[i] += taken
            budget -= taken
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def usable(node: Node, weights: dict[tuple[str, ...], float], path: tuple[str, ...] = ()) -> int:
    """Tokens of the leaves below a node that no weight of 0 leaves out."""
    if weights.get(path, 1.0) <= 0:
        return 0
    return sum(usable(c, weights, (*path, k)) for k, c in node.children.items()) if node.children else node.tokens


def allocate(node: Node, budget: float, weights: dict[tuple[str, ...], float], max_epochs: int, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], float]:
    """Token budget of each leaf. A child's limit is what all leaves below it have, max_epochs times: so a leaf's shortage
    is made up by its siblings while they can, and only then by its parent's siblings. Weights not given are 1; leaves
    that a weight of 0 leaves out do not count among what a node has."""
    if not node.children:
        return {path: budget}
    names = sorted(node.children)
    limits = [float(usable(node.children[k], weights, (*path, k)) * max_epochs) for k in names]
    parts = fill([weights.get((*path, k), 1.0) for k in names], limits, budget)
    out: dict[tuple[str, ...], float] = {}
    for name, part in zip(names, parts, strict=True):
        out |= allocate(node.children[name], part, weights, max_epochs, (*path, name))
    return out


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))).cast("bigint")


def domain_of(source: Column) -> Column:
    """The domain of the given tables' sources: their number modulo 4; others are 'none'."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), number.try_cast("int") % 4)).otherwise("none")


def _order(id_: Column, seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), id_)


def _range_of(order: Column, depth: int) -> Column:
    """Which of the ranges of a depth an order falls in; orders count from the lowest."""
    return F.shiftrightunsigned(order.bitwiseXOR(F.lit(-(2**63))), 64 - BITS * (depth + 1)).bitwiseAND(F.lit(2**BITS - 1)).cast("int")


def leaf_plan(slim: DataFrame, share: float, weights: dict[tuple[str, ...], float], max_epochs: int, seed: int) -> DataFrame:
    """(domain, lang, source, budget, epochs, cut) for each leaf of slim (id, domain, lang, source, tokens): rows are taken
    `epochs` times, and once more where their order in the next epoch is at most cut."""
    spark = slim.sparkSession
    totals = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    have = {tuple(r[k] for k in LEVELS): int(r["tokens"] or 0) for r in totals}
    root = tree_of(list(have.items()))
    budgets = allocate(root, min(share * root.tokens, float(usable(root, weights) * max_epochs)), weights, max_epochs)
    rows = []
    for path, tokens in have.items():
        budget = int(budgets[path] + 1e-6)
        epochs = budget // tokens if tokens else 0
        rows.append((*path, budget, epochs, budget - epochs * tokens))
    schema = "domain string, lang string, source string, budget long, epochs int, rest long"
    leaves = F.broadcast(spark.createDataFrame(rows, schema))  # at most MAX_LEAVES rows
    near = slim.join(leaves, list(LEVELS)).filter("rest > 0").withColumn("order", _order(F.col("id"), seed, F.col("epochs")))
    near = near.select(*LEVELS, "rest", "tokens", "order", F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("prefix"))
    for depth in range(DEPTH):
        near = near.withColumn("range", _range_of(F.col("order"), depth))
        sums = near.groupBy(*LEVELS, "rest", "before", "prefix", "range").agg(F.sum("tokens").alias("tokens"))
        upto = F.col("before") + F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("range"))  # 2 ** BITS rows a leaf at most
        edge = sums.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("tokens")).filter("start <= rest AND upto > rest")
        edge = edge.select(*LEVELS, "range", F.col("start").alias("before"), (F.shiftleft("prefix", BITS) + F.col("range")).alias("prefix"))
        edge = F.broadcast(written(edge, "ranges"))  # one row a leaf
        near = near.drop("before", "prefix").join(edge, [*LEVELS, "range"])
    fits = near.withColumn("sum", F.col("before") + F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("order")))
    cuts = fits.filter("sum <= rest").groupBy(*LEVELS).agg(F.max("order").alias("cut"))
    below = F.shiftleft("prefix", 64 - BITS * DEPTH).bitwiseXOR(F.lit(-(2**63))) - 1
    last = F.when(F.col("prefix") > 0, below)  # of the ranges before
    edges = edge.join(cuts, list(LEVELS), "left").select(*LEVELS, F.coalesce("cut", last).alias("cut"))
    return written(leaves.join(edges, list(LEVELS), "left").select(*LEVELS, "budget", "epochs", "cut"), "leaves")


def mixed(docs: DataFrame, share: float, weights: dict[tuple[str, ...], float] | None = None, max_epochs: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None) -> DataFrame:
    """docs with domain, leaf_budget and copies: how many times each row is taken to mix the sources to their weights.

    share: tokens wanted, as a share of all (over 1 repeats rows, up to max_epochs times). weights: by path (domain,),
    (domain, lang) or (domain, lang, source); 1 where not given, and 0 leaves a part out. Each leaf takes whole seeded
    epochs and of the next one the longest prefix of its rows, in seeded order, that stays within its budget.

    docs need lang and source. Null lang, source and domain count as 'none'; null and empty texts have no tokens and are
    taken with the rows that precede them. Null ids count as one id, and rows that repeat an id are taken or left
    together. A clashing column domain, leaf_budget or copies is replaced, other columns stay. An empty table gives an
    empty result.
    """
    domain = domain_of(F.col("source")) if domain is None else domain
    levels = [F.coalesce(domain, F.lit("none")).alias("domain"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source")]
    slim = written(docs.select(F.col(id_col).alias("id"), *levels, word_count(F.col(text_col)).alias("tokens")), "tokens")
    plan = F.broadcast(leaf_plan(slim, share, weights or {}, max_epochs, seed))  # one row a leaf
    here = docs.select(F.struct("*").alias("row"), *levels)
    taken = F.col("epochs") + F.when(_order(F.col(f"row.`{id_col}`"), seed, F.col("epochs")) <= F.col("cut"), 1).otherwise(0)
    new = {"domain": F.col("domain"), "leaf_budget": F.col("budget"), "copies": taken.cast("int")}
    old = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new]
    return here.join(plan, list(LEVELS)).select(*old, *(c.alias(k) for k, c in new.items()))


def mix_sources(docs: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, as many times as mixed() takes each, with all their columns."""
    given = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), "lang", "source")
    counted = mixed(given, share, id_col="id", text_col="text", **options).filter("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


#: Production mixture: English-heavy, and one domain preferred.
WEIGHTS = {("domain0",): 2.0, **{(f"domain{i}", "en"): 3.0 for i in range(4)}}
SHARE, MAX_EPOCHS = 0.9, 2


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = mixed(docs, SHARE, weights=WEIGHTS, max_epochs=MAX_EPOCHS)
    return out.select("doc_id", "domain", "lang", "source", "leaf_budget", "copies")
