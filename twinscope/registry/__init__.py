"""One runnable query per operator, with check SQL beside it."""

from importlib import import_module

_MODULES = ("profile_queries", "fidelity_queries", "privacy_queries", "history_queries", "source_queries")


def _load():
    for name in _MODULES:
        import_module(f"twinscope.registry.{name}")
    from twinscope.registry.base import QUERIES, SQL

    return QUERIES, SQL


def all_queries() -> dict:
    return dict(_load()[0])


def all_sql() -> dict:
    return dict(_load()[1])
