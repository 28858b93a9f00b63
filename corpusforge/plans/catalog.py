"""All queries over the driver's tables, by name, with the SQL that gives the same rows."""

from corpusforge.plans import corpus, feeds, metrics, models, sampling, urls

PLANS = (urls, corpus, metrics, sampling, feeds, models)
QUERIES: dict = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}
