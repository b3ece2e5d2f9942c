"""loctrack — live-location analytics as Spark DataFrame and Structured Streaming jobs.

Layout:
  functions/   column expressions (UUID check, bounds, time and number text)
  sources/     readers and writers (raw requests, JSON envelopes, metric CSV, heap text, logs)
  operators/   batch operators: validation, keyed state, joins, windows, metrics, series, logs
  streaming/   Structured Streaming forms of the keyed operators
  plans/       stand-in tables derived from the driver tables, and the query catalog
"""

from loctrack.params import JobParams
from loctrack.session import build_session, checkpoint_dir, use_utc

__all__ = ["JobParams", "build_session", "checkpoint_dir", "use_utc"]
