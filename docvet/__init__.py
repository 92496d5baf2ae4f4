"""Vetting untrusted content at scale with Spark."""

__version__ = "0.1.0"
