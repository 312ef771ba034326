"""The registered queries, each over the given tables, with an SQL statement of the same result where SQL can say it."""

from pastward.catalog import base, daily, evaluation, features, linear, models, preprocessing, quality, scale, sources  # noqa: F401

LONG = models.LONG
QUERIES = {name: f for name, f in base.QUERIES.items() if name not in LONG} | {name: base.QUERIES[name] for name in LONG}
ORACLES = base.ORACLES
