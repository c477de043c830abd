"""Strandline: time-series and strategy analytics on Spark DataFrames.

Every public function takes and returns DataFrames in long panel form
``(series_id, ts, value, ...)``.  Loops that a desktop script would run over
tickers, parameters, windows, start dates or folds are key columns here.
"""

__version__ = "0.1.0"
