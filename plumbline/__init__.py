"""Plumbline: scan-evidence analytics as PySpark DataFrame operators.

Every operator is a plain function ``DataFrame(s) -> DataFrame``.  Rejected
records come back as findings rows ``(rule, entity_id, detail)`` instead of
exceptions; pass a findings frame to :func:`plumbline.rules.require_clean` to
fail a job on them.
"""

__version__ = "0.1.0"
