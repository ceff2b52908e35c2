"""PySpark-native engine for preparing and analysing multimodal training data.

Layout: ``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame),
``sources`` (scans, sinks, connectors), ``streaming`` (telemetry streams), ``plans``
(named queries with their SQL oracles) and ``llm`` (optional training-data operators;
nothing else imports it).
"""

__version__ = "0.1.0"
