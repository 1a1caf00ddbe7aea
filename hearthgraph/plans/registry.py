"""Registered queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from hearthgraph.sources import testdata as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
WITH = {"listings": T.LISTINGS_SQL, "analyses": T.ANALYSES_SQL, "images": T.IMAGES_SQL, "obs": T.OBS_SQL}


def query(sql: str | None = None, **ctes: str):
    """Register a query under its function's name. sql may use the views of WITH that it names,
    and further common tables given as keywords, in order."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = " ".join([sql, *ctes.values()])
            used = [x for name, x in WITH.items() if name in text] + [f"{name} AS ({x})" for name, x in ctes.items()]
            ORACLES[f.__name__] = (f"WITH {', '.join(used)} " if used else "") + sql
        return f

    return add


from hearthgraph.plans import all_queries  # noqa: E402, F401
