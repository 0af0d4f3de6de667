"""quillspark: a Spark-native engine for block-structured documents.

Documents are kept as flat tables of typed blocks whose nesting is a pair of
interval numbers, so section queries are range predicates that Catalyst can
plan.  Everything below is DataFrame/SQL first.
"""

__version__ = "0.1.0"

_EXPORTS = {"DocumentStore": "operators.store", "StoreError": "operators.store", "Query": "plans.query", "SqlError": "plans.sqlfront", "number_intervals": "operators.intervals", "parse_blocks": "sources.markdown"}
__all__ = ["__version__", *_EXPORTS]


def __getattr__(name: str):
    if name in _EXPORTS:
        from importlib import import_module

        return getattr(import_module(f"{__name__}.{_EXPORTS[name]}"), name)
    raise AttributeError(name)
