"""Sequence-corpus preparation and evaluation as lazy Spark DataFrame jobs."""

from seqspark.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
