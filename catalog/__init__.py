"""Queries over the test tables, each with the SQL that gives the same rows."""

from catalog import corpus_queries, counting_queries, model_queries, report_queries, search_queries

MODULES = [corpus_queries, counting_queries, model_queries, search_queries, report_queries]

QUERIES = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
