"""All registered queries; importing the query modules fills the registry."""

from loomseq.plans import q_intervals, q_measures, q_reads, q_report  # noqa: F401
from loomseq.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
