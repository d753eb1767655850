"""ledgerline — business-document normalisation and reconciliation on Spark.

Everything is DataFrame in, DataFrame out.  Sub-packages:

* ``sources``   – readers (files, delimited, fixed width, X12, XML, JSON) and sinks
* ``functions`` – column-level transforms (Column -> Column)
* ``operators`` – relational operators: ingest, mapping, rules, reconcile, analysis, quality
* ``plans``     – ready-made plans over the test tables and their SQL oracles
* ``streaming`` – Structured Streaming ingest and incremental reconciliation
"""

__version__ = "0.1.0"
