"""Quality rules judged by host: a host's failure rates, shrunk towards the corpus, decide about its documents.

A document is measured once and fails or passes each rule. Failures are summed per host (the ``source`` column, null a
host of its own) by a map-side partial aggregate. For each rule the hosts' rates give a beta prior by the method of
moments, weighted by documents; a host's rate is the posterior mean, so a host with few documents stays near the
corpus. Two verdicts are joined back:

* a host whose shrunk rate of any rule is over ``HOST_LIMIT`` is rejected with all its documents;
* where a rule's shrunk rate is over ``WATCH_LIMIT``, documents of that host that fail the rule are rejected; below
  it, a rare failure on a trusted host is forgiven.

Base failures (too short, too repetitive) are rejected everywhere.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_row, wrapped, written

HOST_LIMIT, WATCH_LIMIT = 0.5, 0.02
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps"]
RULES = ["short", "repeats", "symbols", "dup_lines", "caps"]


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one whole text; all 0 for null."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        twice = bytearray(len(windows))
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                twice[i] = twice[j] = 1
        end = 0
        for i in range(len(windows)):
            if twice[i]:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated, len(lines), sum(map(bytes.isupper, words)))


def failures() -> dict[str, Column]:
    """Rule to condition over MEASURES."""
    c = F.col
    return {"short": c("n_words") < 50, "repeats": 100 * c("n_repeat_words") > 50 * c("n_words"),
            "symbols": 10 * c("n_symbols") > 3 * c("n_words"), "dup_lines": 2 * c("n_dup_lines") > c("n_lines"),
            "caps": 2 * c("n_caps") > c("n_words")}


def measured(df: DataFrame, keep: int, field: str | None = None) -> DataFrame:
    """The first ``keep`` columns, then MEASURES of the last column (a text), or of the first column's field of that name."""
    def make():
        return lambda texts: tuple(map(list, zip(*map(measure, texts)))) if texts else tuple([] for _ in MEASURES)
    return per_row(df, ", ".join(f"{m} bigint" for m in MEASURES), make, keep=keep, field=field)


def prior_of(mean: float | None, square: float | None) -> tuple[float, float]:
    """Mean and strength of the beta prior whose first two moments are the hosts'; strength 1 to a million."""
    mean = mean or 0.0
    spread = (square or 0.0) - mean * mean
    return mean, 1e6 if spread <= 1e-12 else max(1.0, min(1e6, (mean - square) / spread))


def host_rates(m: DataFrame) -> DataFrame:
    """Measured documents with ``host`` to one row per host: the shrunk failure rate of each rule, ``rate_<rule>``."""
    hosts = written(m.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(cond).alias(rule) for rule, cond in failures().items()]), "hosts")
    rate = {r: F.col(r) / F.col("n") for r in RULES}
    moments = hosts.agg(*chain.from_iterable((
        (F.sum(r) / F.sum("n")).alias(f"m_{r}"),
        (F.sum(F.col("n") * rate[r] * rate[r]) / F.sum("n")).alias(f"s_{r}")) for r in RULES)).first()
    prior = {r: prior_of(moments[f"m_{r}"], moments[f"s_{r}"]) for r in RULES}
    return hosts.select("host", *[((F.col(r) + k * mean) / (F.col("n") + k)).alias(f"rate_{r}")
                                  for r, (mean, k) in prior.items()])


def judged(m: DataFrame, rates: DataFrame) -> DataFrame:
    """Measured documents with ``base_failed`` and ``kept``."""
    fails = failures()
    host_bad = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > HOST_LIMIT
    watched = [fails[r] & (F.col(f"rate_{r}") > WATCH_LIMIT) for r in RULES]
    own = watched[0]
    for w in watched[1:]:
        own = own | w
    rates = rates.withColumnRenamed("host", "host_of")
    return (m.join(rates, m.host.eqNullSafe(rates.host_of))
            .withColumn("base_failed", fails["short"] | fails["repeats"])
            .withColumn("kept", ~(F.col("base_failed") | host_bad | own)))


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id, measures, ``base_failed`` and ``kept`` per document.

    Null or empty texts have no words and fail. Rows with a null or repeated doc_id are judged like any other. An empty
    table gives no rows; other columns are not read.
    """
    m = measured(docs.select("doc_id", F.col("source").alias("host"), "text"), keep=2)
    m = written(m, "measures")
    return judged(m, host_rates(m))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents kept, with their columns. Texts are measured twice rather than shuffled.

    Null and empty texts have no words and go; documents of the null source are judged as one host's. Very long texts are
    measured whole, repeated rows and null ids row by row, rates at a limit pass. Names of other columns don't matter. An
    empty table gives no rows.
    """
    rates = host_rates(measured(docs.select(F.col("source").alias("host"), "text"), keep=1))
    rows = measured(wrapped(docs, host=F.col("source")), keep=2, field="text")
    return judged(rows, rates).where("kept").select("row.*")


#: DuckDB twin of ``judge_documents`` for the contract's columns.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
       list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*')) AS ls FROM d),
win AS (SELECT i, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g
        FROM (SELECT i, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
rep AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT i, count(DISTINCT q) AS n FROM (SELECT i, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY i),
m AS (SELECT w.i, doc_id, host, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
       len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_caps
      FROM w LEFT JOIN cov USING (i)),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
       10 * n_symbols > 3 * n_words AS symbols, 2 * n_dup_lines > n_lines AS dup_lines,
       2 * n_caps > n_words AS caps FROM m),
h AS (SELECT host, count(*) AS n, {sums} FROM f GROUP BY host),
p AS (SELECT {moments} FROM h),
k AS (SELECT {strengths} FROM p),
r AS (SELECT host, {rates} FROM h, k)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats OR greatest({all_rates}) > {host_limit} OR {own}) AS kept
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host
""".format(
    sums=", ".join(f"count(*) FILTER ({r}) AS {r}" for r in RULES),
    moments=", ".join(f"sum({r}) / sum(n) AS m_{r}, sum(n * ({r} / n) * ({r} / n)) / sum(n) AS s_{r}" for r in RULES),
    strengths=", ".join(f"m_{r}, CASE WHEN s_{r} - m_{r} * m_{r} <= 1e-12 THEN 1e6 ELSE greatest(1.0, least(1e6, "
                        f"(m_{r} - s_{r}) / (s_{r} - m_{r} * m_{r}))) END AS k_{r}" for r in RULES),
    rates=", ".join(f"({r} + k_{r} * m_{r}) / (n + k_{r}) AS rate_{r}" for r in RULES),
    all_rates=", ".join(f"rate_{r}" for r in RULES), host_limit=HOST_LIMIT,
    own=" OR ".join(f"({r} AND rate_{r} > {WATCH_LIMIT})" for r in RULES))
