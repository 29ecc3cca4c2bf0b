"""murmur: comment analytics on Spark.

Every operator is a plain function from DataFrame (plus parameters) to
DataFrame, or Column to Column for the scalar helpers in
``murmur.functions``. Report jobs in ``murmur.plans.reports`` chain them.

Layout
------
sources/    readers, writers, model persistence, driver-table fixtures
functions/  Column -> Column helpers (buckets, rounding, tokens, hashing)
operators/  DataFrame -> DataFrame operators (prepare, text, sentiment,
            features, stats, cluster, model, evaluate, similarity)
plans/      report jobs and the query catalog used by ``__spark_entry__``
streaming/  the same stateless scoring applied to a streaming DataFrame
"""

__version__ = "0.1.0"
