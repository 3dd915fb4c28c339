"""Single-cell chromatin-contact analytics written as Spark DataFrame operators."""

from contactmill.study import Study, study_from_tables

__all__ = ["Study", "study_from_tables"]
