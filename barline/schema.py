"""Column contracts and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BARS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.DateType()),
    T.StructField("close", T.DoubleType()),
])
TICKS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("close", T.DoubleType()),
])
AUX = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("value", T.DoubleType()),
])
SUBSCRIBERS = T.StructType([
    T.StructField("subscriber_id", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("webhook_url", T.StringType()),
    T.StructField("tickers", T.ArrayType(T.StringType())),
    T.StructField("notify_consensus", T.BooleanType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
])

# --- fixed values: these must equal the published model for results to agree ---

FEATURES_V1 = [
    "mom_5", "mom_20", "mom_63", "mom_252",
    "vol_short", "vol_ewma", "vol_long", "vol_yearly",
    "vol_ratio_sl", "vol_ratio_ly", "shock_z", "drawdown_252", "autocorr_63", "trend_dir",
]
FEATURES_V2_ADD = [
    "vix_log", "vix_change", "vix_term", "vix_slope", "vix_curvature", "vix6m_slope",
    "skew_log", "vvix_log", "corr_tlt_63", "corr_gld_63", "term_spread", "credit_spread",
    "yang_zhang_vol",
]
FEATURES_V2 = FEATURES_V1 + FEATURES_V2_ADD

AUX_SERIES = ["vix", "vix3m", "vix6m", "vix9d", "skew", "vvix", "tlt", "gld",
              "term_spread", "credit_spread"]

MOMENTUM_BARS = [5, 20, 63, 252]
VOL_ALPHAS = {"vol_short": 0.15, "vol_ewma": 0.06, "vol_long": 0.02, "vol_yearly": 0.005}
SHOCK_ALPHA = 0.02
MIN_PERIODS = 20

REGIME_NAMES = {0: "Bull", 1: "Neutral", 2: "Bear"}
REGIME_ALLOC = {0: 1.0, 1: 0.0, 2: -0.5}
REGIME_COLORS = {0: "#22c55e", 1: "#a3a3a3", 2: "#ef4444"}
# Symbols and texts of the alert format.
REGIME_EMOJI = {"Bull": "🟢", "Neutral": "⚪", "Bear": "🔴"}
RISK_EMOJI = {"high": "⚠️", "medium": "🔶", "low": ""}
ALERT_BULLET, ALERT_RISK_LEAD, ALERT_RISK_TEXT = "  • ", "  ", " transition risk: "
ALERT_SUBJECT, ALERT_HEAD = "Regime Alert: ", "Regime Change Alert — {}"
ALERT_CONSENSUS = "\nMarket Consensus: {} ({}) → {} ({})"
ALERT_CHANGES, ALERT_NO_CHANGES = "\nRegime Changes:\n", "\nNo individual asset regime changes."
ALERT_FOOT = "Regime Monitor | Unsubscribe: reply with UNSUBSCRIBE"
SWITCHING_ALLOC = (1.0, -0.3)
K3_ALLOC = (1.0, 0.0, -0.5)
K4_ALLOC = (1.0, 0.5, -0.25, -0.5)

RULE_FEATURES = [
    "mom_5", "mom_20", "mom_63", "mom_252", "vol_short", "vol_ewma", "vol_long", "vol_yearly",
    "vol_ratio_sl", "vol_ratio_ly", "shock_z", "drawdown_252", "autocorr_63", "trend_dir",
    "vix_log", "vix_change", "vix_term", "corr_tlt_63", "corr_gld_63", "term_spread",
    "credit_spread",
]
RULE_WEIGHTS = {
    0: [0.10, 0.14, 0.10, 0.05, -0.07, -0.10, -0.06, -0.03, -0.04, -0.02, -0.05, 0.07, 0.0, 0.16,
        -0.06, -0.03, -0.03, -0.02, 0.0, 0.03, -0.04],
    1: [-0.04, -0.05, -0.03, 0.0, 0.03, 0.04, 0.03, 0.0, 0.02, 0.02, 0.02, 0.02, 0.05, -0.06,
        0.02, 0.0, 0.02, 0.0, 0.01, 0.0, 0.02],
    2: [-0.06, -0.08, -0.07, -0.04, 0.07, 0.10, 0.08, 0.04, 0.05, 0.03, 0.10, -0.13, 0.0, -0.08,
        0.10, 0.06, 0.07, 0.04, 0.04, -0.05, 0.08],
}
TAIL_GATED = ["vol_short", "vol_ewma", "vol_long", "shock_z", "drawdown_252", "vix_log",
              "credit_spread"]
SOFTMAX_TEMP = 2.8
HYSTERESIS = 0.04
MIN_PERSIST = 1
NORM_WINDOW = 252
OVEREXT_BARS, OVEREXT_PENALTY, STALE_NEUTRAL_BARS = 60, 0.20, 30
PROMOTE_SHOCK, PROMOTE_DD = 3.5, 0.15
DEMOTE_SHOCK, DEMOTE_DD = 2.0, 0.035

COST_BPS_DEFAULT = 2.0
ASSET_COST_BPS = {
    "SPY": 0.5, "QQQ": 0.5, "DIA": 0.75, "IWM": 1.0, "EFA": 1.5, "EEM": 2.0, "GLD": 1.0,
    "TLT": 1.0, "BTC-USD": 10.0, "ETH-USD": 12.0, "SOL-USD": 15.0, "JPY=X": 0.5,
    "EURUSD=X": 0.5, "GBPUSD=X": 0.5, "AUDUSD=X": 0.75,
}
ILLIQUIDITY_CLIP = (0.5, 3.0)
ANNUAL_BARS = 252
HISTORY_BARS = 504
EULER_GAMMA = 0.57721566490153286
VOL_STATE_PRIOR = ((0.70, 0.30, 0.00), (0.00, 0.00, 1.00))

TICKER_PATTERN = r"^[A-Z0-9.\-^]{1,20}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

# --- end of fixed values ---


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail early, by name, when an operator's input lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}; have {df.columns}")
    return df


def require_daily(df: DataFrame) -> DataFrame:
    """Bars must be keyed by calendar day.

    One row per symbol and DATE bounds every per-symbol window by the calendar (a century of
    trading is under 40k rows), however many raw rows the symbol had. Finer data goes through
    ``operators.realised`` first, which has no per-symbol window on rows.
    """
    require(df, "symbol", "ts", "close")
    if not isinstance(df.schema["ts"].dataType, T.DateType):
        raise TypeError("bars.ts must be DATE; resample ticks with ohlc_bars first")
    return df
