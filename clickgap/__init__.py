"""clickgap: search-opportunity analytics as Spark DataFrame jobs.

Entry points: ``clickgap.plans.runner.run`` (end-to-end),
``clickgap.sources.exports.read_exports`` (CSV exports in any header
language), ``clickgap.config.Config`` (run parameters).
"""

__version__ = "0.1.0"
