"""All queries of this subpackage."""

from tidewatch.llm import centroids, decontaminate, license_scan, mixing, negatives, quality, simhash, substrings, token_counts, tokens, toxicity, url_filter, vectors  # noqa: F401
from tidewatch.llm.registry import QUERIES, SQL  # noqa: F401
