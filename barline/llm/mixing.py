"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: each source's share of the mix by weight, at most ``CAP`` times its words, the excess shared again by weight
   until no source is above. In closed form: sources in order of capacity by weight; a prefix of them is full.
2. Blocks: documents are dealt by a hash of their id to blocks of about ``BLOCK_WORDS`` words of one source. A pass over
   a source draws its blocks in a permuted order; a source whose target is more than its words makes several passes. The
   last block is drawn in part, documents in a permuted order while they fit, so the words taken come near the target. This gives each source an exact number of block draws.
3. Tree: the quotas of draws by source are halved from the root to the output shards; at each node the left half's
   quotas are one multivariate hypergeometric draw, so each shard gets an exact number of draws of each source and all
   shards together get all of them.
4. Draws: a shard's draws of a source are the next disjoint stretch of that source's permuted order. Documents follow
   their blocks' draws and each shard is shuffled locally by a hash.

Everything is a function of ids, words and the seed: reruns agree. The tables of sources, blocks and tree nodes are
small (a block stands for some hundred documents); documents meet them by equi-joins on (source, block), never grouped
by source, so a source with a third of all rows is many blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import wrapped, written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
BLOCK_WORDS, SHARD_WORDS, FILLS, SEED = 1 << 16, 1 << 20, 3, 20240


def count_words(text: F.Column) -> F.Column:
    """Words of a text, 0 for null: each becomes one byte, then the bytes between them are taken off; no list of words."""
    word = "[^\\x20\\x09-\\x0D]+"
    marked, gaps = (F.octet_length(F.regexp_replace(text, word, by)) for by in ("x", ""))
    return F.coalesce(marked - gaps, F.lit(0)).cast("bigint")


def sized(df: DataFrame) -> DataFrame:
    """All columns but the last one, a text, then ``size``, its number of words."""
    *keep, text = df.columns
    return df.select(*keep, count_words(F.col(text)).alias("size"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to the same with ``target``; one row per source goes in and out."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.select("source", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double").alias("w"))
    by = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    upto, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = (share * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    s = s.withColumn("level", left / F.sum("w").over(rest))
    full = F.col("level") * F.col("w") >= cap * F.col("source_size")
    s = s.withColumn("full", full)
    # Sources before the first one that isn't full are full; the level there holds for all after it.
    s = s.withColumn("open_level", F.min(F.when(~F.col("full"), F.struct(
        (F.col("source_size") / F.col("w")).alias("k"), (-F.col("level")).alias("level")))).over(every)["level"] * -1)
    return s.select("source", "source_size", F.when(F.col("full"), cap * F.col("source_size")).otherwise(
        F.least(F.col("open_level") * F.col("w"), cap * F.col("source_size"))).alias("target"))


def block_of(block_words: int) -> F.Column:
    """A document's block within its source, from a hash of its id and of its words."""
    count = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block_words)))
    return F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "h"), count)


def filled(d: DataFrame, by: list[str], order: str, size: str) -> DataFrame:
    """Rows in ``order`` taken while they fit ``left``; then, past the first that doesn't, those that fit what is left,
    ``FILLS`` times in all. Adds ``in0``.. per time, ``cut0``.. as (after, upto, most), and lowers ``left``.

    Rows with equal places are taken together or not at all.
    """
    every, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    d = d.withColumn("after", F.lit(None).cast("bigint"))
    for k in range(FILLS):
        fits = (F.col("after").isNull() | (F.col(order) > F.col("after"))) & (F.col(size) <= F.col("left"))
        d = d.withColumn("sum", F.sum(F.when(fits, F.col(size))).over(upto)).withColumn(
            f"in{k}", fits & (F.col("sum") <= F.col("left")))
        taken = F.col(f"in{k}")
        d = d.withColumn(f"cut{k}", F.struct("after", F.max(F.when(taken, F.col(order))).over(every).alias("upto"),
                                             F.col("left").alias("most")))
        d = d.withColumn("left", F.col("left") - F.coalesce(F.sum(F.when(taken, F.col(size))).over(every), F.lit(0)))
        d = d.withColumn("after", F.coalesce(F.col(f"cut{k}.upto"), "after"))
    return d.drop("sum", "after")


def draw_table(blocks: DataFrame, seed: int) -> DataFrame:
    """Blocks (source, block, words, longest, source_size, target) to draws: source, block, lap, nth, take.

    Full laps draw all blocks. The last lap draws blocks in a permuted order while they fit, and one more in part:
    ``take`` is the number of words to draw from it, null for whole blocks. ``nth`` counts a source's draws from 0.
    """
    d = blocks.where("words > 0").withColumn("laps", F.floor(
        F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    cols = ["source", "block", F.col("lap").cast("bigint").alias("lap"), "order", F.col("take").cast("double").alias("take")]
    whole = d.where("laps > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.col("laps") - 1)))
    whole = whole.withColumn("order", F.xxhash64(F.lit(seed), "lap", "block")).withColumn("take", F.lit(None)).select(*cols)
    last = d.withColumn("lap", F.col("laps")).withColumn("order", F.xxhash64(F.lit(seed), "lap", "block")).withColumn(
        "left", F.col("target") - F.col("laps") * F.col("source_size"))
    last = filled(last, ["source"], "order", "words")
    drawn_whole = F.col("in0")
    for k in range(1, FILLS):
        drawn_whole = drawn_whole | F.col(f"in{k}")
    last = last.withColumn("whole", F.coalesce(drawn_whole, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("source", "whole").orderBy("longest", "order", "block"))
    last = last.withColumn("rank", rank).where("whole OR (rank = 1 AND left > 0)").withColumn(
        "take", F.when(~F.col("whole"), F.col("left"))).select(*cols)
    nth = F.row_number().over(Window.partitionBy("source").orderBy("lap", "order", "block")) - 1
    return whole.unionByName(last).select("source", "block", "lap", nth.alias("nth"), "take")


def split_quotas(quotas: pd.DataFrame, node: int, total: int, left: int, seed: int) -> np.ndarray:
    """The left half's quotas of a node: ``left`` of ``total`` draws without replacement over the node's sources."""
    rng = np.random.Generator(np.random.PCG64([seed, node]))
    out = np.zeros(len(quotas), dtype=np.int64)
    for i, q in enumerate(quotas):
        if left > 0:
            out[i] = rng.hypergeometric(int(q), int(total - q), int(left)) if total > q else left
            left -= out[i]
            total -= q
    return out


def tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, quota) to (shard, source, quota): one grouped step per level, one group per node."""
    nodes = quotas.select(F.lit(1).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("lo"),
                          F.lit(shards).cast("bigint").alias("hi"), "source", "quota")
    schema = "node bigint, lo bigint, hi bigint, source string, quota bigint"

    def halve(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, node = int(pdf.lo.iloc[0]), int(pdf.hi.iloc[0]), int(pdf.node.iloc[0])
        if hi - lo == 1:
            return pdf
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        mid, total = (lo + hi) // 2, int(pdf.quota.sum())
        left = split_quotas(pdf.quota.to_numpy(), node, total, total * (mid - lo) // (hi - lo), seed)
        halves = [pdf.assign(node=2 * node, hi=mid, quota=left), pdf.assign(node=2 * node + 1, lo=mid,
                                                                            quota=pdf.quota - left)]
        return pd.concat([h[h.quota > 0] for h in halves])

    for _ in range((shards - 1).bit_length()):
        nodes = nodes.groupBy("node").applyInPandas(halve, schema)
    return nodes.select(F.col("lo").alias("shard"), "source", "quota")


def turn(seed: int) -> F.Column:
    """A document's place in its block's permuted order of a lap."""
    return F.xxhash64(F.lit(seed), "lap", "doc_id", "h")


def cut_points(dealt: DataFrame, part: DataFrame, seed: int) -> DataFrame:
    """What to take of the blocks drawn in part: (s, in_lap, cut), ``cut`` an array of (after, upto, most)."""
    part = part.select(F.col("source").alias("s"), F.col("block").alias("b"), "lap", F.col("take").alias("left"))
    d = (dealt.join(part, dealt.source.eqNullSafe(part.s) & (dealt.block == part.b))
         .select("s", "lap", "size", "left", turn(seed).alias("turn")))
    return filled(d, ["s", "lap"], "turn", "size").groupBy("s", F.col("lap").alias("in_lap")).agg(
        F.first(F.array(*[f"cut{k}" for k in range(FILLS)])).alias("cut"))


def plan(docs: DataFrame, weights: tuple, share: float, cap: float, block_words: int, shard_words: int,
         seed: int) -> tuple[DataFrame, DataFrame]:
    """Sized documents (doc_id, h, source, size) to sources with targets, and draws with their shards.

    A draw's ``cut`` says what is taken of a block drawn in part, null for whole blocks.
    """
    totals = written(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goal = written(targets(totals, weights, share, cap), "targets")
    dealt = with_block(docs, goal, block_words)
    size_of = goal.withColumnRenamed("source", "s")
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"),
                                                   F.max("size").alias("longest"))
    draws = written(draw_table(blocks.join(size_of, blocks.source.eqNullSafe(size_of.s)).drop("s"), seed), "draws")
    cuts = cut_points(dealt, draws.where("take IS NOT NULL"), seed)
    quotas = draws.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    mixed = goal.agg(F.sum("target")).first()[0] or 0.0
    shares = tree(quotas, max(1, int(-(-mixed // shard_words))), seed)
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("lo", F.coalesce(F.sum("quota").over(upto), F.lit(0))).select(
        "shard", F.col("source").alias("s"), F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("quota") - 1)).alias("n"))
    placed = draws.join(shares, draws.source.eqNullSafe(shares.s) & (draws.nth == shares.n)).drop("s", "n")
    placed = placed.join(cuts, placed.source.eqNullSafe(cuts.s) & (placed.lap == cuts.in_lap)
                         & F.col("take").isNotNull(), "left")
    return goal, written(placed.where("take IS NULL OR cut IS NOT NULL").select(
        "source", "block", "lap", "shard", "cut"), "placed")


def with_block(docs: DataFrame, goal: DataFrame, block_words: int) -> DataFrame:
    size_of = goal.select(F.col("source").alias("s"), "source_size")
    return docs.join(size_of, docs.source.eqNullSafe(size_of.s)).withColumn("block", block_of(block_words)).drop(
        "s", "source_size")


def drawn(docs: DataFrame, goal: DataFrame, draws: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Documents with a row for each time the mix takes them: all columns, ``lap`` and ``shard``."""
    d = with_block(docs, goal, block_words)
    draws = draws.select(F.col("source").alias("s"), F.col("block").alias("b"), "lap", "shard", "cut")
    return d.join(draws, d.source.eqNullSafe(draws.s) & (d.block == draws.b)).withColumn(
        "turn", turn(seed)).where(F.expr(
            "cut IS NULL OR exists(cut, c -> (c.after IS NULL OR turn > c.after) AND turn <= c.upto AND size <= c.most)")
    ).drop("s", "b", "cut", "block", "turn")


def mix_sizes(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP,
              block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    Null texts have size 0 and are taken 0 words; a null source is a source, last in order. Repeated rows are dealt to
    one block but drawn and reported row by row; null ids are dealt by their words. An empty table gives no rows. Other
    columns are not read.
    """
    d = written(sized(docs.select("doc_id", F.xxhash64("text").alias("h"), "source",
                                  F.monotonically_increasing_id().alias("row_id"), "text")), "sizes")
    goal, draws = plan(d, weights, share, cap, block_words, shard_words, seed)
    taken = drawn(d, goal, draws, block_words, seed).groupBy("row_id").agg(F.sum("size").alias("taken"))
    goal_of = goal.withColumnRenamed("source", "s")
    return (d.join(goal_of, d.source.eqNullSafe(goal_of.s)).join(taken, "row_id", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself: documents with their columns, once for each time they are taken, shard by shard.

    Rows of a shard lie in one partition, shuffled by a hash of the document and the lap. Null and empty texts have no
    size and are never taken; the null source is a source, last in order. A very long document is taken whole or not at
    all in a lap. Rows that repeat are drawn one by one, equal places in the shuffle keep any order, null ids are dealt by
    their words. Columns keep their names and order; an empty table gives no rows.
    """
    small = written(sized(docs.select("doc_id", F.xxhash64("text").alias("h"), "source", "text")), "sizes")
    goal, draws = plan(small, weights, share, cap, block_words, shard_words, seed)
    rows = sized(wrapped(docs, doc_id=F.col("doc_id"), h=F.xxhash64("text"), source=F.col("source"),
                         text=F.col("text")))
    got = drawn(rows, goal, draws, block_words, seed)
    order = F.xxhash64(F.lit(seed), "shard", "lap", "doc_id", "h")
    return got.withColumn("order", order).repartition("shard").sortWithinPartitions("shard", "order").select("row.*")
