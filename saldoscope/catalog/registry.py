"""Registered queries. Each is a callable (spark, sf_dir) -> DataFrame plus, where SQL can
say the same thing, the checking SQL under the same name."""

from ..session import tune
from . import oracle

QUERIES: dict = {}
CHECKED: list[str] = []
#: Queries that also run on the book with one account for each user.
BY_USER = ["velocity_bursts", "outflow_24h", "daily_spikes", "carding", "recurring_payments", "recurring_rows"]


def query(name: str, sql: str | None = None):
    """Register a function of a Book under ``name``."""
    def wrap(fn):
        from ..plans.book import Book

        def run(spark, sf_dir):
            return fn(Book.open(tune(spark), sf_dir))

        QUERIES[name] = run
        if name in BY_USER:
            QUERIES[f"{name}_by_user"] = lambda spark, sf_dir: fn(Book.open(tune(spark), sf_dir, by_user=True))
        if sql is not None:
            oracle.fragment(name, sql)
            CHECKED.append(name)
        return fn
    return wrap
