"""Operators of a training-data pipeline. Importing the subpackage registers
their queries. Nothing else in the library imports it."""

from tidewater.llm import audit, chat, decontaminate, html, langid, mixing, pii, quality, repair, simhash, substrings, toxicity, warc  # noqa: F401
from tidewater.llm.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
