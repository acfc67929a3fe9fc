"""litrank: literature-evidence ranking on Spark.

Rank catalog items (drugs, protein targets) by how strongly a body of articles
ties them to free-text queries, for a whole table of queries at once, with
DataFrame and SQL expressions only. Entry points:

* ``litrank.plans.ranking.rank_queries``        B1, the long-form ranking
* ``litrank.plans.output.respond``       B1 + article lists + nested JSON (O1)
* ``litrank.plans.batch_jobs``           popular-query cache (B2), corpus scoring (B3), ingest (B4)
* ``litrank.streaming.dump_stream``      scoring and linking of arriving dump files
* ``litrank.session.get_session``        session defaults (AQE, skew join, UTC, no UI)
"""

__version__ = "0.1.0"
