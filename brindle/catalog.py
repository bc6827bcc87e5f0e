"""All queries of the relational part, by name, and the SQL of those that SQL can express."""

from brindle.plans import ORACLE_SQL, QUERIES, aggregates, io, joins, relational, scalars, streams, udfs, windows  # noqa: F401  the modules register theirs
