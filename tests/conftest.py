import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def closes():
    """Two seeded series of different volatility."""
    rng = np.random.default_rng(7)
    frames = []
    for name, vol, n in (("AA", 0.012, 420), ("BB", 0.025, 380)):
        frames.append(pd.DataFrame({"symbol": name, "ts": pd.bdate_range("2015-01-01", periods=n).date,
                                    "close": 100 * np.exp(np.cumsum(rng.normal(3e-4, vol, n)))}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, closes):
    from barline.functions.frame import with_pos
    return with_pos(spark.createDataFrame(closes, "symbol string, ts date, close double")).persist()
