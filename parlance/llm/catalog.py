"""The queries of this subpackage and their SQL."""

from parlance.llm import ensemble, language, packing, pii, prefixhash, rules, sharding, simhash, structure, toolcalls, warc, whitening, winnow  # noqa: F401
from parlance.llm.common import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
