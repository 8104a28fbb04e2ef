"""treeline: cataloging and searching collections of source-code projects
as Spark jobs.

Entry points:

* ``treeline.sources.repo_tree.read_tree`` -- list project trees (files DataFrame)
* ``treeline.operators.scan`` / ``docs`` / ``catalog`` / ``history`` -- inventory and catalog jobs
* ``treeline.operators.text_index`` / ``vectors`` / ``search`` / ``grep`` -- search
* ``treeline.plans.pipelines.run_scan`` -- incremental / full scan into a ``CatalogStore``
* ``treeline.streaming.jobs`` -- Structured Streaming variants
"""

__version__ = "0.1.0"
