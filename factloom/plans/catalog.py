"""All registered queries of the library and the SQL that says the same."""

from factloom.plans import evaluation, ingest, retrieval, timeline, usage

_PARTS = (retrieval, evaluation, ingest, timeline, usage)
QUERIES = {name: query for part in _PARTS for name, query in part.add.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.add.sql.items()}
