"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent and normalised. The
exponent is the smallest in [0, 1] (the flattest mix) at which the mix's entropy is no higher
than the target and no source is repeated more often than the limit; it is found by
bisection. A source's budget is its weight times the token budget. Budgets are realised as
passes: each pass over a source is a permutation by blocks (documents in order of a hash of
seed, pass and doc_id; a block is a common prefix of it), whole passes first, then the part of
one more pass that still fits. That part ends at one hash per source, found from block
sums and the rows of a single block, so no source is ever sorted as a whole.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.session import stored

STEPS = 50
BLOCK_ROWS = 4096  # documents of a block, about


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))


def mixture(totals: DataFrame, evenness: float, max_repeats: float, budget: int | None, cover: bool) -> DataFrame:
    """Per source: weight, exponent, passes, rest. ``totals``: source, tokens, rows; one row per source.

    The sources stand in one array: their number is that of labels, not of documents.
    """
    one = totals.agg(F.collect_list(F.struct("source", "tokens", "rows")).alias("s"), F.sum("tokens").alias("total"))
    one = one.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x: x.tokens > 0), lambda x: x.tokens / F.col("total"))))
    power = lambda a: _total(F.col("p"), lambda x: F.pow(x, a))

    def entropy(a: Column) -> Column:
        z = power(a)
        return F.log(z) - a * _total(F.col("p"), lambda x: F.pow(x, a) * F.log(x)) / z

    def repeats(a: Column) -> Column:  # of the least frequent source; shares are sorted
        low, high = F.element_at("p", 1), F.element_at("p", -1)
        return F.pow(low, a - 1) / F.pow(high, a - 1) if cover else F.pow(low, a - 1) / power(a) * F.col("budget") / F.col("total")

    one = one.withColumn("budget", F.lit(budget).cast("long") if budget is not None else F.col("total"))
    one = one.withColumn("target", entropy(F.lit(1.0)) + evenness * (F.log(F.size("p").cast("double")) - entropy(F.lit(1.0))))
    fits = lambda a: (entropy(a) <= F.col("target") + 1e-12) & (repeats(a) <= max_repeats)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc.lo + acc.hi) / 2
        return F.when(fits(mid), F.struct(acc.lo.alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), acc.hi.alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve, lambda acc: acc.hi)
    one = one.withColumn("alpha", F.round(F.when(fits(F.lit(0.0)), 0.0).otherwise(found), 9))
    one = one.withColumn("z", power(F.col("alpha")))
    share = F.col("tokens") / F.col("total")
    rows = one.select(F.inline("s"), "total", "budget", "alpha", "z", F.element_at("p", -1).alias("top"))
    rows = rows.withColumn("weight", F.when(F.col("tokens") > 0, F.round(F.pow(share, F.col("alpha")) / F.col("z"), 12)).otherwise(0.0))
    if cover:  # the largest source is read exactly once
        given = F.pow(share / F.col("top"), F.col("alpha")) * F.col("top") * F.col("total")
    else:
        given = F.col("weight") * F.col("budget")
    tokens = F.when(F.col("tokens") > 0, F.floor(F.round(given, 3))).otherwise(0)
    rows = rows.withColumn("given", tokens)
    if cover:
        rows = rows.withColumn("given", F.greatest("given", "tokens"))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(1 if cover else 0)
    digits = F.when(F.col("rows") <= BLOCK_ROWS, 0).otherwise(F.ceil(F.round(F.log(F.col("rows") / BLOCK_ROWS) / F.log(F.lit(16.0)), 9)))
    return rows.select("source", "tokens", "weight", "alpha", passes.cast("long").alias("passes"), (F.col("given") - passes * F.col("tokens")).cast("long").alias("rest"), digits.cast("int").alias("digits"))


def _order(seed: int, turn: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mixed(docs: DataFrame, evenness: float = 0.5, max_repeats: float = 4.0, budget: int | None = None, cover: bool = False, seed: int = 17) -> DataFrame:
    """The mix of ``docs`` (doc_id, source, text): each drawn document once for each pass that takes it.

    Added columns: pass (from 0), block, pass_order (order within source and pass), weight; columns of ``docs`` with
    these names are replaced. ``evenness``: target entropy, as a place between that of the token shares (0) and of equal
    weights (1). ``budget``: tokens (words) to draw, by default as many as there are. ``cover``: instead draw as few
    as keep every document at least once; repeats then count from the least repeated source. If even the
    natural shares break the limit, they are used. A null source is a source; null ids order as empty text. A source without words gets no
    weight (its documents stay if ``cover``, else go). Equal rows are drawn together. An empty table gives an empty mix.
    """
    docs = docs.drop("pass", "block", "pass_order", "weight")
    own = "CAST(NULL AS STRING)" if "source" not in docs.columns else "CAST(source AS STRING)"
    narrow = stored(docs.select("doc_id", F.expr(own).alias("source"), words(F.col("text").cast("string")).alias("tokens")), "tokens")
    totals = narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = stored(mixture(totals, evenness, max_repeats, budget, cover), "mixture")

    key = F.col("p.source").eqNullSafe(F.col("d.source"))
    last = narrow.alias("d").join(plan.where("rest > 0").alias("p"), key).select("d.doc_id", "d.source", "d.tokens", "p.rest", "p.digits", _order(seed, F.col("p.passes")).alias("h"))
    last = last.withColumn("block", F.substring("h", F.lit(1), F.col("digits")))
    blocks = last.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    edge = blocks.withColumn("before", before).where("before <= rest AND before + tokens > rest").select("source", "block", "before")
    inside = last.alias("l").join(edge.alias("e"), F.col("l.source").eqNullSafe(F.col("e.source")) & (F.col("l.block") == F.col("e.block"))).select("l.source", "l.h", "l.tokens", "l.rest", "e.before")
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("h"))
    cut = inside.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min("h").alias("cut"))
    plan = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "c.cut")
    # one column beside the key, of a name that docs does not have
    held = "mix"
    while held.lower() in {c.lower() for c in docs.columns}:
        held += "_"
    plan = stored(plan.select(F.col("source").alias("key"), F.struct("weight", "passes", "rest", "digits", "cut").alias("plan")), "mixture")

    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    same = F.col("p.key").eqNullSafe(F.col("d.source").cast("string") if "source" in docs.columns else F.lit(None).cast("string"))
    drawn = docs.alias("d").join(plan.alias("p"), same).select(*columns, F.col("p.plan").alias(held))
    passes, rest, cut = (F.col(held)[c] for c in ("passes", "rest", "cut"))
    drawn = drawn.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), passes))).withColumn("pass_order", _order(seed, F.col("pass")))
    drawn = drawn.where((F.col("pass") < passes) | ((rest > 0) & (cut.isNull() | (F.col("pass_order") < cut))))
    block = F.substring("pass_order", F.lit(1), F.col(held)["digits"])
    return drawn.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("pass").cast("int").alias("pass"), block.alias("block"), "pass_order", F.col(held)["weight"].alias("weight"))
