"""All queries of this subpackage; importing it registers them."""

from __future__ import annotations

from tickloom.llm import chat, decontaminate, fingerprints, hard_negatives, heap_kmeans, language_id, near_dedup, packing, personal_data, quality, tokens, toxicity, url_filter  # noqa: F401
from tickloom.llm.registry import ORACLE, QUERIES  # noqa: F401
