"""A decorator that keeps each query beside its SQL text."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomseq.plans.views import view, with_views
from loomseq.sources.scratch import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The functions of the queries, which several may run on the same tables.
PLANS: dict[str, Callable[[Tables], DataFrame]] = {}


#: Views that group a whole table: made once where several queries read them.
GROUPED = ("bedm", "cnvx", "tcov")


class Tables:
    """Views and tables of one input folder, by attribute; ``several`` says that more than one query reads them."""

    def __init__(self, spark: SparkSession, sf_dir: str, several: bool = False):
        self.spark, self.sf_dir, self.several = spark, sf_dir, several
        self._held: dict[str, DataFrame] = {}
        self._making: dict[str, threading.Lock] = defaultdict(threading.Lock)

    def __getattr__(self, name: str) -> DataFrame:
        plain = lambda: view(self.spark, self.sf_dir, name)
        return self.held(name, plain) if name in GROUPED else plain()

    def held(self, name: str, make: Callable[[], DataFrame], twice: bool = False) -> DataFrame:
        """What ``make`` gives, as a scratch table made once if several queries ask for it or one does so ``twice``."""
        if not (self.several or twice):
            return make()
        with self._making[name]:
            if name not in self._held:
                self._held[name] = settle(make())
        return self._held[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``@view`` in the text names a view."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        PLANS[name] = fn
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return fn

    return wrap
