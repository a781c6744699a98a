"""Every operator as a query over the test tables, with the SQL that must give the same rows."""

from . import changes, comparison, values

QUERIES = changes.QUERIES | values.QUERIES | comparison.QUERIES
ORACLE_SQL = changes.ORACLE_SQL | values.ORACLE_SQL | comparison.ORACLE_SQL
