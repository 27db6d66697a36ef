"""Transaction-ledger analytics on Spark.

Load statements, standardise and classify descriptions with a rule table, check
quality, and compute report, dashboard and drift tables. Every operator takes
and returns Spark DataFrames.
"""

from tallybook.facade import Ledger, Report, Rules

__all__ = ["Ledger", "Report", "Rules"]
