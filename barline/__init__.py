"""barline: market-regime analytics over tables of many series, as Spark DataFrame jobs."""
