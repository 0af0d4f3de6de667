"""All registered queries of the library proper."""

from . import queries_functions, queries_market, queries_relational, queries_store, queries_text, queries_tree  # noqa: F401
from .base import ORACLES, QUERIES, register, table  # noqa: F401
