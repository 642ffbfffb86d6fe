"""Sensor time-series engine on PySpark.

Every operator is a function from DataFrame to DataFrame, keyed by
``tidegrid.keys.KEYS`` and ordered by ``(ts, seq)``.
"""
