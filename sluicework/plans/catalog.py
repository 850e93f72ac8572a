"""All queries of the library by name, and their SQL."""

from . import curve_queries, document_queries, output_queries, store_queries

QUERIES: dict = {**curve_queries.QUERIES, **document_queries.QUERIES, **store_queries.QUERIES, **output_queries.QUERIES}
ORACLE: dict = {**curve_queries.ORACLE, **document_queries.ORACLE, **store_queries.ORACLE, **output_queries.ORACLE}
