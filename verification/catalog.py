"""All registered queries and their SQL."""

from verification import core_queries, eval_queries, text_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (core_queries, text_queries, eval_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
