"""Subscriber state, matching of changes to subscriptions, and the outbox of messages.

Subscribers with the same set of tickers hear the same, so a digest is built once per distinct set (``*`` is one) and
messages refer to it by its id: no subscriber-by-change product is formed, and bodies are stored once per digest.
Subscribers are known by ``subscriber_id``, since webhook-only ones have no email. Delivery itself is outside Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import lookup

ALL = "*"


def active_subscribers(subs: DataFrame) -> DataFrame:
    return subs.where(F.coalesce("active", F.lit(True)))


def fold_subscribers(log: DataFrame) -> DataFrame:
    """Current state from an append-only log (seq, op, email, webhook_url, tickers, notify_consensus, created_at).

    Adds without email or webhook are refused. For one email, a later add reactivates and
    overwrites webhook and tickers only when given; notify_consensus and created_at stay those of
    the first add; remove soft-deletes. Webhook-only entries are never merged.
    """
    ok = log.where((F.col("op") == "remove") | F.col("email").isNotNull() | F.col("webhook_url").isNotNull())
    key = F.coalesce(F.concat(F.lit("e:"), "email"), F.concat(F.lit("s:"), F.col("seq").cast("string")))
    add = F.col("op") == "add"
    given = F.when(add & (F.size("tickers") > 0), F.col("tickers"))
    state = ok.withColumns({"_key": key, "_tickers": given}).groupBy("_key").agg(
        F.max("email").alias("email"),
        F.max_by("webhook_url", F.when(add & F.col("webhook_url").isNotNull(), F.col("seq"))).alias("webhook_url"),
        F.max_by("_tickers", F.when(F.col("_tickers").isNotNull(), F.col("seq"))).alias("tickers"),
        F.min_by("notify_consensus", F.when(add, F.col("seq"))).alias("notify_consensus"),
        F.min_by("created_at", F.when(add, F.col("seq"))).alias("created_at"),
        F.max_by(add, "seq").alias("active"), F.max(add.cast("int")).alias("_added"))
    return state.where("_added = 1").select(
        F.col("_key").alias("subscriber_id"), "email", "webhook_url", F.coalesce("tickers", F.array(F.lit("*"))).alias("tickers"),
        F.coalesce("notify_consensus", F.lit(True)).alias("notify_consensus"), "active", "created_at")


def ticker_sets(subs: DataFrame) -> DataFrame:
    """Subscribers with ``digest_id``, their sorted distinct tickers as text; a wildcard absorbs the others."""
    none = F.col("tickers").isNull() | (F.size("tickers") == 0) | F.array_contains("tickers", ALL)
    return subs.withColumn("digest_id", F.when(none, F.lit(ALL)).otherwise(
        F.array_join(F.array_sort(F.array_distinct("tickers")), ",")))


def change_lines(changes: DataFrame) -> DataFrame:
    """One text line per change."""
    risk = F.col("risk_level") if "risk_level" in changes.columns else F.lit(None).cast("string")
    tag = F.when(risk.isNotNull() & (risk != "low"), F.concat(
        F.lit(S.ALERT_RISK_LEAD), F.coalesce(lookup(risk, S.RISK_EMOJI), F.lit("")), F.lit(S.ALERT_RISK_TEXT), risk)).otherwise("")
    name = F.col("name") if "name" in changes.columns else F.col("symbol")
    emoji = {c: F.coalesce(lookup(c, S.REGIME_EMOJI), F.lit("")) for c in ("from_regime", "to_regime")}
    line = F.concat(F.lit(S.ALERT_BULLET), "symbol", F.lit(" ("), name, F.lit("): "), emoji["from_regime"], F.lit(" "),
                    "from_regime", F.lit(" → "), emoji["to_regime"], F.lit(" "), "to_regime", tag)
    return changes.withColumn("line", line)


def digest_lines(subs: DataFrame, changes: DataFrame) -> DataFrame:
    """(digest_id, symbol, line): the changes that each distinct ticker set hears."""
    lines = change_lines(changes).select("symbol", "line")
    sets = ticker_sets(subs).select("digest_id").distinct()
    named = sets.where(F.col("digest_id") != ALL).select("digest_id", F.explode(F.split("digest_id", ",")).alias("symbol"))
    wild = sets.where(F.col("digest_id") == ALL).isEmpty()
    listed = named.join(lines, "symbol").select("digest_id", "symbol", "line")
    return listed if wild else listed.unionByName(lines.select(F.lit(ALL).alias("digest_id"), "symbol", "line"))


def digests(lines: DataFrame) -> DataFrame:
    """Per digest: how many changes, and the first three symbols."""
    w = Window.partitionBy("digest_id").orderBy("symbol")
    first = lines.withColumn("_n", F.row_number().over(w)).where("_n <= 3").groupBy("digest_id").agg(
        F.array_sort(F.collect_list("symbol")).alias("symbols"))
    return lines.groupBy("digest_id").agg(F.count(F.lit(1)).alias("n_changes")).join(first, "digest_id")


def match_subscribers(subs: DataFrame, changes: DataFrame) -> DataFrame:
    """Subscribers that hear of a change: subscriber_id, digest_id, n_changes and the first three symbols."""
    found = digests(digest_lines(subs, changes))
    return ticker_sets(subs).select("subscriber_id", "digest_id").join(found, "digest_id").select(
        "subscriber_id", "digest_id", "n_changes", "symbols")


def consensus_text(consensus_change: DataFrame) -> str | None:
    """The line on the newest consensus change; the frame has at most one row."""
    row = consensus_change.select("from_regime", "from_level", "to_regime", "to_level").first()
    if row is None:
        return None
    return S.ALERT_CONSENSUS.format(*[x or d for x, d in zip(row, ("—", "", "—", ""))])


def outbox(subs: DataFrame, changes: DataFrame, consensus_change: DataFrame, curr_date: str) -> DataFrame:
    """One message per subscriber with something to hear: its subject and the id of its body (see ``bodies``)."""
    told = consensus_text(consensus_change) is not None
    people = ticker_sets(subs).select("subscriber_id", "digest_id",
                                      (F.coalesce("notify_consensus", F.lit(True)) & F.lit(told)).alias("with_consensus"))
    rows = people.join(digests(digest_lines(subs, changes)), "digest_id", "left")
    rows = rows.where("n_changes IS NOT NULL OR with_consensus").withColumn("n_changes", F.coalesce("n_changes", F.lit(0)))
    more = F.when(F.col("n_changes") > 3, F.concat(F.lit(" +"), (F.col("n_changes") - 3).cast("string"), F.lit(" more"))).otherwise("")
    subject = F.concat(F.lit(S.ALERT_SUBJECT), F.coalesce(F.array_join("symbols", ", "), F.lit("")), more,
                       F.lit(f" ({curr_date})"))
    return rows.select("subscriber_id", "digest_id", "with_consensus", "n_changes", subject.alias("subject"))


def bodies(messages: DataFrame, subs: DataFrame, changes: DataFrame, consensus_change: DataFrame, curr_date: str) -> DataFrame:
    """(digest_id, with_consensus, body) for the bodies that messages refer to; a body is one text, gathered once."""
    lines = digest_lines(subs, changes).groupBy("digest_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("symbol", "line"))), lambda x: x["line"]), "\n").alias("_lines"))
    rows = messages.select("digest_id", "with_consensus").distinct().join(lines, "digest_id", "left")
    changed = F.when(F.col("_lines").isNotNull(), F.concat(F.lit(S.ALERT_CHANGES), F.col("_lines"))).otherwise(S.ALERT_NO_CHANGES)
    told = F.when(F.col("with_consensus"), F.lit(consensus_text(consensus_change)))
    return rows.select("digest_id", "with_consensus", F.concat_ws(
        "\n", F.lit(S.ALERT_HEAD.format(curr_date)), F.lit("=" * 50), told, changed, F.lit("\n" + "-" * 50),
        F.lit(S.ALERT_FOOT)).alias("body"))


def dispatch_counts(subs: DataFrame, messages: DataFrame) -> DataFrame:
    """Dry-run totals: one send per channel of a matched subscriber, the rest skipped."""
    rows = subs.join(messages.select("subscriber_id", F.lit(1).alias("_hit")), "subscriber_id", "left")
    channels = F.col("email").isNotNull().cast("int") + F.col("webhook_url").isNotNull().cast("int")
    return rows.agg(F.coalesce(F.sum(F.when(F.col("_hit") == 1, channels)), F.lit(0)).alias("sent"),
                    F.count_if(F.col("_hit").isNull()).alias("skipped"))
