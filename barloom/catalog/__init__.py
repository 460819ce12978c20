"""Registered queries and their SQL twins, grouped as in the operator inventory."""
from functools import lru_cache
from importlib import import_module

# fixed order of the groups
GROUPS = ("flagship", "sources", "quality", "calendars", "scalars", "windows", "joins", "events", "statistics",
          "labelling", "models", "history", "relational", "streams", "functions_sql")


@lru_cache
def load():
    from barloom.catalog.fixtures import Catalog
    cat = Catalog()
    for group in GROUPS:
        try:
            module = import_module(f"barloom.catalog.{group}")
        except ModuleNotFoundError as e:
            if e.name != f"barloom.catalog.{group}":
                raise
            continue
        module.register(cat)
    return cat
