"""Market consensus across symbols and change detection between snapshots.

Tables are keyed by ``generated_at``. Votes are reduced by (snapshot, label) with map-side partial
aggregates, and per-voter results stay rows: no snapshot is gathered into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import lookup
from ..functions.ranged import lag_by_range


def asset_vote(df: DataFrame, fused: str = "fusion_label", rule: str = "label",
               fused_probs=("fusion_p0", "fusion_p1", "fusion_p2"), rule_probs=("p_0", "p_1", "p_2")) -> DataFrame:
    """Each asset's vote: the fused label and vector when present, else the rule's."""
    def top(cols) -> Column:
        vals = [F.col(c) for c in cols]
        some = F.coalesce(*vals)
        return F.when(some.isNotNull(), F.greatest(*[F.coalesce(v, F.lit(0.0)) for v in vals]))

    return df.withColumns({"vote": F.coalesce(fused, rule), "top_prob": F.coalesce(top(fused_probs), top(rule_probs))})


def consensus_level(share: Column) -> Column:
    return F.when(share >= 0.80, "strong").when(share >= 0.60, "moderate").when(share >= 0.40, "split").otherwise("divided")


def market_consensus(votes: DataFrame, score: str = "confidence_score") -> DataFrame:
    """Plurality per snapshot; ties go to the surer side, then to the first symbol seen."""
    per = votes.where("vote IS NOT NULL").groupBy("generated_at", "vote").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("top_prob", F.lit(0.0))).alias("_sure"),
        F.min("symbol").alias("_first"), F.avg(score).alias("_score"))
    snap = Window.partitionBy("generated_at")
    ranked = per.withColumn("_rn", F.row_number().over(snap.orderBy(F.desc("_n"), F.desc("_sure"), "_first")))
    counts = [F.coalesce(F.sum(F.when(F.col("vote") == k, F.col("_n"))), F.lit(0)).alias(f"n_{n.lower()}")
              for k, n in S.REGIME_NAMES.items()]
    lead = F.col("_rn") == 1
    won = ranked.groupBy("generated_at").agg(
        F.max(F.when(lead, F.col("vote"))).alias("regime_label"), F.max(F.when(lead, F.col("_n"))).alias("agreement_count"),
        F.sum("_n").alias("n_assets"), F.max(F.when(lead, F.col("_score"))).alias("mean_confidence"), *counts)
    # snapshots where nobody could vote still get a row
    seen = votes.groupBy("generated_at").agg(F.count_if(F.col("vote").isNull()).alias("n_failed"))
    out = seen.join(won, "generated_at", "left")
    zero = ["agreement_count", "n_assets", "n_bull", "n_neutral", "n_bear"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    share = F.coalesce(F.col("agreement_count") / F.nullif(F.col("n_assets"), F.lit(0)), F.lit(0.0))
    return out.withColumns({"regime": lookup("regime_label", S.REGIME_NAMES), "agreement_pct": share, "level": consensus_level(share)})


def voters(votes: DataFrame, consensus: DataFrame) -> DataFrame:
    """Every vote with whether it agrees; dissenters are the rows where it does not."""
    won = consensus.select("generated_at", "regime_label")
    return votes.where("vote IS NOT NULL").join(won, "generated_at").withColumn("agrees", F.col("vote") == F.col("regime_label"))


def latest_snapshots(snapshots: DataFrame, n: int = 2) -> DataFrame:
    """Rows of the newest n snapshots with their rank; the ranking runs on distinct dates only."""
    newest = snapshots.select("generated_at").distinct().orderBy(F.desc("generated_at")).limit(n)
    ranked = newest.withColumn("snapshot_rank", F.rank().over(Window.orderBy(F.desc("generated_at"))))
    return snapshots.join(F.broadcast(ranked), "generated_at")


def compare_assets(snapshots: DataFrame) -> DataFrame:
    """Newest against previous snapshot for symbols in both with a label in both."""
    two = latest_snapshots(snapshots)
    cur = two.where("snapshot_rank = 1").select("symbol", F.col("generated_at").alias("curr_date"), F.col("label").alias("to_label"),
                                                *[c for c in ("name", "risk_level") if c in snapshots.columns])
    prev = two.where("snapshot_rank = 2").select("symbol", F.col("generated_at").alias("prev_date"), F.col("label").alias("from_label"))
    both = cur.join(prev, "symbol").where("from_label IS NOT NULL AND to_label IS NOT NULL")
    return both.withColumns({"changed": F.col("from_label") != F.col("to_label"),
                             "from_regime": lookup("from_label", S.REGIME_NAMES), "to_regime": lookup("to_label", S.REGIME_NAMES)})


def asset_changes(snapshots: DataFrame) -> DataFrame:
    return compare_assets(snapshots).where("changed").drop("changed")


def consensus_change(consensus: DataFrame) -> DataFrame:
    """Snapshots whose regime or level differs from the one before. One row per snapshot enters."""
    rows = consensus.select("generated_at", F.col("regime").alias("to_regime"), F.col("level").alias("to_level"))
    out = lag_by_range(rows, [], ["generated_at"], {"from_regime": "to_regime", "from_level": "to_level", "prev_date": "generated_at"})
    differs = ~F.col("to_regime").eqNullSafe(F.col("from_regime")) | ~F.col("to_level").eqNullSafe(F.col("from_level"))
    return out.where(F.col("prev_date").isNotNull() & differs)


def change_report(compared: DataFrame, consensus_changes: DataFrame) -> DataFrame:
    """One row for the newest pair: how many assets changed, stayed, and whether anything did."""
    head = compared.groupBy("prev_date", "curr_date").agg(
        F.count_if("changed").alias("n_changed"), F.count_if(~F.col("changed")).alias("n_unchanged"))
    cons = consensus_changes.select(F.col("generated_at").alias("curr_date"), "prev_date", F.lit(True).alias("consensus_changed"))
    out = head.join(cons, ["curr_date", "prev_date"], "left").withColumn(
        "consensus_changed", F.coalesce("consensus_changed", F.lit(False)))
    return out.withColumn("has_changes", (F.col("n_changed") > 0) | F.col("consensus_changed"))


def previous_snapshot(snapshots: DataFrame) -> DataFrame:
    """The rotated copy: rows of the snapshot before the newest."""
    return latest_snapshots(snapshots).where("snapshot_rank = 2").drop("snapshot_rank")
