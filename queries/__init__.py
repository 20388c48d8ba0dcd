"""One query per operator of the inventory, each with its SQL where SQL can say it."""

from queries import aggregations, composites, filters, forests, joins, projections, scans, windows

MODULES = (scans, projections, filters, joins, aggregations, windows, composites, forests)


def all_queries() -> dict:
    return {name: run for m in MODULES for name, run in m.BOOK.queries.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.BOOK.oracles.items()}
