"""What `__spark_entry__` takes from this subpackage."""

from granthika.llm.queries import queries
from granthika.llm.sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
