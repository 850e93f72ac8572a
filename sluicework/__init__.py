"""Sluicework: a PySpark-native engine for engineering curves, unit selection, document corpora and bills of materials."""
