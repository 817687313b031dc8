"""graindeck: evidence-preserving analytics over multi-grain product data, on Spark DataFrames.

Sub-packages: ``sources`` (scans, sinks, publication), ``functions`` (Column builders), ``operators``
(DataFrame operators), ``plans`` (queries over named tables, with their SQL oracles), ``streaming``
(Structured Streaming extensions) and ``llm`` (training-data operators; optional, imported by nothing else).
"""
__version__ = "0.1.0"
