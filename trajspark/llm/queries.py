"""All queries of this subpackage with their SQL."""

from trajspark.llm import ballcodes, bitslices, jaccard, mixing, pii, quality, repetition, runindex, tiling, tokens, toxicity, urlrules, warc  # noqa: F401
from trajspark.llm.storage import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
