"""How the modules of this package register their queries."""

from __future__ import annotations


def registry():
    queries, oracles = {}, {}

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle:
                oracles[f.__name__] = oracle
            return f

        return add

    return queries, oracles, query
