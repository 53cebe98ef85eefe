"""cartograph: site maps and context experiments as Spark jobs.

Subpackages
-----------
functions   Column -> Column expressions (HTML, URLs, text, JSON, prompts)
sources     readers, derived fixture tables and sinks
operators   DataFrame -> DataFrame operators (traversal, site map, lint,
            experiment aggregation, coverage, batch inference, report)
plans       named queries used by ``__spark_entry__`` and their DuckDB twins
streaming   incremental site-map refresh on a stream of captured pages
"""

__version__ = "0.1.0"
