"""Spark-native engine for datasets of time-stamped events grouped by subject."""

from importlib import import_module

# Names are loaded on first use, so that workers importing one module don't load all.
_HOMES = {
    "Event": "subject",
    "MutableEvent": "subject",
    "MutableSubject": "subject",
    "Subject": "subject",
    "SubjectDatabase": "database",
    "convert": "sources.convert",
    "transform_dataset": "transform",
    "verify_database": "verify",
    "write_subset": "sources.subset",
}

__all__ = list(_HOMES)


def __getattr__(name: str):
    if name in _HOMES:
        return getattr(import_module(f"annalist.{_HOMES[name]}"), name)
    raise AttributeError(f"module 'annalist' has no attribute {name!r}")
