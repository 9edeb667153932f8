"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, durable, named, plain


def targets(sources: DataFrame, weights: list[float], share: float, ceiling: float) -> DataFrame:
    """Target words of each source: `share` of all words by weight, none above `ceiling` times its own words.

    Weights go to the sources in code-point order, null last, repeating. What a full source leaves is reshared
    among the others by weight until none is above its ceiling: the water level is found over the sources sorted
    by ceiling per weight, with prefix sums. One row for each source: a small table in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("limit", F.col("words") * F.lit(float(ceiling)))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("spent", F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("all_words", F.sum("words").over(every))
    s = s.withColumn("level", (F.col("all_words") * F.lit(float(share)) - F.col("spent")) / F.col("open"))
    # the first source that the level doesn't fill fixes it for all after it; among equal ones the least is spent before the first
    s = s.withColumn("stop", F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct((F.col("limit") / F.col("weight")).alias("k"), "spent", "level"))).over(every))
    return s.select("source", "words", "weight", F.least(F.coalesce(F.col("weight") * F.col("stop.level"), F.col("limit")), F.col("limit")).alias("target"))


def _unit(*key: Column) -> Column:
    """A uniform number in (0, 1) that depends on the key alone."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _hypergeometric(u: Column, total: Column, good: Column, drawn: Column) -> Column:
    """The u-quantile of the count of good ones among `drawn` of `total`: the ratio recurrence in logs."""
    low = F.greatest(F.lit(0), drawn - (total - good))
    high = F.least(good, drawn)
    ratio = lambda k: F.log((good - k) * (drawn - k) / ((k + 1) * (total - good - drawn + k + 1)))
    logs = F.when(high > low, F.aggregate(
        F.sequence(low, high - 1),
        F.array(F.lit(0.0)),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + ratio(k.cast("double")))),
    )).otherwise(F.array(F.lit(0.0)))
    picked = F.transform(F.array(logs), lambda x: F.transform(F.array(F.array_max(x)), lambda m: F.transform(x, lambda v: F.exp(v - m)))[0])
    found = F.transform(picked, lambda p: F.transform(F.array(F.aggregate(p, F.lit(0.0), lambda a, v: a + v) * u), lambda goal: F.aggregate(
        p,
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + F.when(a["s"] + v < goal, 1).otherwise(0)).alias("n")),
        lambda a: a["n"],
    ))[0])[0]
    return F.least(high, low + found)


def splitting_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Divides exact block quotas (source, quota) among `shards` shards (a power of two).

    The root holds all quotas in one row. At each level a node splits its blocks in two halves; how many of each
    source go left is multivariate hypergeometric, drawn source by source, each given those before it. So every
    shard gets its exact number of blocks, a random mix of the sources, and the shards' parts of a source add up
    to its quota. Returns (source, shard, quota, skip), skip being the source's blocks in the shards before.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("quota").cast("int").alias("q")))).alias("parts")).withColumn("node", F.lit(1))
    for _ in range(shards.bit_length() - 1):
        total = F.aggregate("parts", F.lit(0), lambda a, x: a + x["q"])
        node = node.withColumn("total", total).withColumn("half", F.floor((F.col("total") + F.pmod(F.col("node"), F.lit(2))) / 2).cast("int"))
        start = F.struct(F.col("total").alias("left"), F.col("half").alias("want"), F.array().cast("array<int>").alias("out"))

        def draw(a: Column, x: Column) -> Column:
            k = _hypergeometric(_unit(F.col("node"), x["source"], F.lit(seed)), a["left"], x["q"], a["want"])
            step = F.transform(F.array(k), lambda k: F.struct((a["left"] - x["q"]).alias("left"), (a["want"] - k).alias("want"), F.concat(a["out"], F.array(k)).alias("out")))
            return step[0]

        node = node.withColumn("gone", F.aggregate("parts", start, draw)["out"])
        kept = F.zip_with("parts", "gone", lambda x, g: F.struct(x["last"].alias("last"), x["source"].alias("source"), g.alias("q")))
        rest = F.zip_with("parts", "gone", lambda x, g: F.struct(x["last"].alias("last"), x["source"].alias("source"), (x["q"] - g).alias("q")))
        node = node.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), kept.alias("parts")), F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("parts")))).alias("x")).select("x.node", "x.parts")
    leaf = node.select((F.col("node") - shards).alias("shard"), F.explode("parts").alias("p")).select("shard", "p.source", F.col("p.q").alias("quota"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("skip", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def mix(
    docs: DataFrame,
    weights: list[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    ceiling: float = 2.0,
    shards: int = 16,
    blocks: int = 256,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: bool = False,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """Draws a mix in which every source has its target words.

    A source's rows are dealt by a hash of the row into `blocks` disjoint blocks, permuted by that hash. Its
    draw is its blocks, in permuted order, over and over, until the target's words are reached: whole passes,
    then a run of whole blocks, then one block of which the first rows (in hash order) are taken, the last of
    them in part, so that the words taken equal the rounded target. The splitting tree divides the blocks among
    the shards; in a shard the rows are ordered by a hash (`position`).

    What a row gives follows from its hash and a table of (source, block), `blocks` rows for each source. That table
    and others of a row or a few for each source are counted: up to broadcast_rows they are broadcast, so that texts
    are not moved; larger ones are joined by their key. The block that is taken in part is cut at one of 4096 ranges of
    its hash, so that one task orders only that range of it.

    Returns (id, source, size, source_size, target, taken, draws), or with keep all columns and taken and draws;
    draws is an array of (shard, position, words), one for each copy the mix takes; sum of words = taken. A row is
    never taken over `ceiling` times its size. Size counts words. Null text: size 0, never taken. Null sources form
    one source, the last. Rows alike in id, text and source share one fate (at the cut, each gives an equal part,
    rounded down). Empty table: no rows. A source without words has target 0. Other columns are ignored, whatever
    their names; with keep, those of the new names are replaced. The result depends on the rows and the seed only.
    """
    base, (key, text, origin) = plain(docs, id_col, text_col, source_col)
    rows = base.select(
        "*",
        F.col(origin).cast("string").alias("_source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.col(origin)).alias("_tie"),
    ).withColumn("_block", F.pmod(F.col("_tie"), F.lit(blocks)).cast("int"))
    own = ["_source", "_size", "_tie", "_block"]
    narrow = durable(rows.select(*own) if keep else rows.select(F.col(key).alias("_id"), *own))
    by_block = narrow.select(F.col("_source").alias("source"), F.col("_block").alias("block"), F.col("_size").alias("size"))
    by_block = durable(by_block.groupBy("source", "block").agg(F.sum("size").alias("words")))
    goal = durable(targets(by_block.groupBy("source").agg(F.sum("words").alias("words")), list(weights), share, ceiling))
    small = lambda df: bounded(df, broadcast_rows)
    # (source, block): at most `blocks` rows for each source
    # blocks without words come last: the last pass does not draw them, and its draws are numbered without gaps
    permuted = Window.partitionBy("source").orderBy(F.col("words") == 0, F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    upto = F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = (
        by_block.withColumn("nth", F.row_number().over(permuted) - 1)
        .withColumn("upto", upto)
        .withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("source")))
        .join(small(goal.select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target")), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
    )
    goal_words = F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(ceiling)))).cast("long")
    laid = laid.withColumn("goal", goal_words).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("int"))
    laid = laid.withColumn("more", F.col("goal") - F.col("passes") * F.col("source_size"))
    # of the last pass: the words that this block gives, all or some of them
    laid = laid.withColumn("last", F.greatest(F.lit(0), F.least(F.col("words"), F.col("more") - (F.col("upto") - F.col("words")))))
    laid = durable(laid)
    used = laid.groupBy("source").agg(F.sum(F.col("passes") + F.when(F.col("last") > 0, 1).otherwise(0)).alias("quota"))
    tree = splitting_tree(used, shards, seed)
    spans = tree.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("skip", "quota", "shard"))).alias("cuts"))
    spans = durable(spans.select(F.col("source").alias("s"), "cuts"))
    where = lambda seq: F.get(F.filter("cuts", lambda c: (c["skip"] <= seq) & (seq < c["skip"] + c["quota"])), F.lit(0))["shard"]
    # the blocks' draws are numbered pass by pass in permuted order; the last pass holds the first blocks only
    draws = F.transform(
        F.sequence(F.lit(0), F.col("passes")),
        lambda p: F.struct(p.alias("copy"), where(p * F.col("n_blocks") + F.col("nth")).alias("shard"), F.when(p < F.col("passes"), F.col("words")).otherwise(F.col("last")).alias("words")),
    )
    # in the block that gives only some of its words, rows give all up to a hash, a part at it, nothing beyond
    some = durable(laid.where("last > 0 and last < words").select(F.col("source").alias("s"), F.col("block").alias("b"), "last"))
    reach = F.shiftright(F.col("_tie"), 52).cast("int")  # ranges of the hash, in its order
    same = narrow.withColumn("_reach", reach).join(small(some), F.col("_source").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b")))
    parts = same.groupBy("s", "last", "_reach").agg(F.sum("_size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("_reach").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = parts.withColumn("before", upto - F.col("words")).where("before < last and last <= before + words")
    at = durable(at.select(F.col("s").alias("s2"), F.col("_reach").alias("reach"), "before"))
    same = same.join(small(at), F.col("s").eqNullSafe(F.col("s2")) & (F.col("_reach") == F.col("reach")))
    same = same.groupBy("s", "_tie", "last", "before").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("alike"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = same.withColumn("before", F.col("before") + upto - F.col("words")).where("before < last and last <= before + words")
    cuts = durable(cuts.select("s", F.col("_tie").alias("cut"), F.floor((F.col("last") - F.col("before")) / F.col("alike")).alias("part")))
    dealt = laid.join(small(spans), F.col("source").eqNullSafe(F.col("s"))).drop("s").join(small(cuts), F.col("source").eqNullSafe(F.col("s")), "left")
    dealt = dealt.select(
        F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "cut", "part",
        F.filter(draws, lambda d: d["words"] > 0).alias("block_draws"), F.col("words").alias("block_words"),
    )
    dealt = small(durable(dealt))
    out = (rows if keep else narrow).join(dealt, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b")))
    given = lambda d: F.when((d["words"] == F.col("block_words")) | (F.col("_tie") < F.col("cut")), F.col("_size")).when(F.col("_tie") == F.col("cut"), F.least("part", "_size")).otherwise(0)
    each = F.transform("block_draws", lambda d: F.struct(
        d["shard"].alias("shard"), F.xxhash64(F.lit(seed + 2), "_tie", d["copy"]).alias("position"), given(d).cast("long").alias("words")
    ))
    out = out.withColumn("draws", F.filter(each, lambda d: d["words"] > 0)).withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    if keep:
        return named(out, docs, ["taken", "draws"])
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", "taken", "draws")
