"""Unsupervised clone detection for code and text, written as Spark DataFrame jobs."""

from cloneflow.session import build_session

__all__ = ["build_session"]
