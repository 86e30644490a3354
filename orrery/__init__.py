"""Orrery: a PySpark-native retrieval analytics engine.

Every public operator takes and returns DataFrames; nothing collects data that
grows with the input to the driver.
"""
