"""cohorte: treatment-adherence analytics written as Spark DataFrame jobs.

Layout
------
- ``cohorte.schemas``     declared ``StructType`` for every table and report
- ``cohorte.session``     session defaults (AQE, UTC, checkpoint folder)
- ``cohorte.functions``   column expressions (parsing, text, dates, rounding)
- ``cohorte.operators``   DataFrame -> DataFrame building blocks
- ``cohorte.plans``       the business queries and jobs built from operators
- ``cohorte.sources``     readers, writers and the test-table adapter
- ``cohorte.streaming``   Structured Streaming versions of ingest/scoring/monitoring
- ``cohorte.oracle``      independent DuckDB SQL for every SQL-checkable registered query
"""

__version__ = "0.1.0"
