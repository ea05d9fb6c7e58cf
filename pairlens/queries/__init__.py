"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from . import joins, matching, scores, stages, statistics, strings, topics, vectors

QUERIES = {k: v for m in (scores, joins, statistics, strings, matching, vectors, topics, stages) for k, v in m.QUERIES.items()}
SQL = {k: v for m in (scores, joins, statistics, strings, matching, vectors, topics, stages) for k, v in m.SQL.items()}
