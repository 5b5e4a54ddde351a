"""pipelens: Spark-native analytics over pipeline operations data.

Three families of DataFrame operators, all planned end to end by Catalyst:

* F  execution-log features (skew, spill, percentiles, Gini, critical path)
* N  job-name standardisation against rule tables
* G  table / column lineage as graph operations over assignment facts

Every operator is ``f(df, ..., **params) -> DataFrame`` or ``Column -> Column``.
"""

from pipelens.session import build_session, checkpoint_root  # noqa: F401

__all__ = ["build_session", "checkpoint_root"]
