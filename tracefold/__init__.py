"""tracefold: process-mining and event-log analytics written for Spark.

An event log is a DataFrame (see ``tracefold.log``); operators live in
``tracefold.operators``, reusable plan fragments in ``tracefold.plans``,
readers and writers in ``tracefold.sources``, column helpers in
``tracefold.functions``.
"""

from .log import EventLog  # noqa: F401
