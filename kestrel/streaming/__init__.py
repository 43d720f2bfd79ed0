"""Streaming.

The analytics this library re-expresses are batch by nature: bars arrive by
full reload and every relation is recomputed from the stored facts, with no
watermarks, event-time windows or late data. No streaming operator is
provided; incremental arrival is handled by the batch refresh job
(``kestrel.plans.job``), which rewrites derived tables atomically.
"""
