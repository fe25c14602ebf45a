"""Every operator as a runnable query over the shared tables, with equivalent SQL."""

from parlance.catalog import base
from parlance.catalog import extraction, graph, scoring, sources, stats, streaming, text, vectors  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLE)
