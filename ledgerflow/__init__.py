"""ledgerflow: transaction and fraud analytics as Spark DataFrame, SQL and Structured Streaming jobs.

Every public operator takes and returns a ``DataFrame`` and stays lazy unless its docstring says it
runs a (bounded) job, e.g. the distributed exact percentile.
"""

from ledgerflow.session import checkpoint_dir, get_session, work_path

__all__ = ["get_session", "checkpoint_dir", "work_path"]
