"""Spark-first invoice-audit analytics: typed tables in, DataFrame-to-DataFrame operators, tables out."""
