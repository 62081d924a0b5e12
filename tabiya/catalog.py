"""The queries of the engine's own operators and the SQL that gives the same rows."""

from __future__ import annotations

from tabiya.plans import twins
from tabiya.session import ship


def _shipped(query):
    def run(spark, sf_dir):
        return query(ship(spark), sf_dir)

    return run


QUERIES = {name: _shipped(f) for name, f in twins.QUERIES.items()}
ORACLES = dict(twins.ORACLES)
