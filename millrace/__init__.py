"""millrace: a Spark-first analytics engine.

Sub-packages: ``sources`` (readers, landing-zone ingest, table store), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame transforms), ``plans`` (whole queries and
their SQL twins), ``streaming`` (Structured Streaming jobs) and ``llm`` (training-data
operators, optional: nothing else imports it).
"""
