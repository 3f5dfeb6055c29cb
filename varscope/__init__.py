"""Configuration-variable analytics over source-code corpora, on PySpark."""
