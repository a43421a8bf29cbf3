"""tickloom: market-event normalization and transformation as Spark DataFrame operators.

Every public function takes and returns DataFrames or Columns.  The core work is built-in
expressions, windows and Structured Streaming state, so Spark distributes it by row, key or file.
"""

from tickloom.session import configure, local_session

__all__ = ["configure", "local_session"]
