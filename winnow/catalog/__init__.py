"""The registered queries and their SQL twins."""

from winnow.catalog import score_queries, store_queries, text_queries, train_queries  # noqa: F401  (register)
from winnow.catalog.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
