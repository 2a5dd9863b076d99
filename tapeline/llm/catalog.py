"""The registered queries of this subpackage."""

from __future__ import annotations

from tapeline.llm.common import ORACLES, QUERIES, Query


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from tapeline.llm import embeddings, licenses, mixing, packing, periodic, quality, simhash, substrings, token_counts, toxicity, urls, vector_codes, warc  # noqa: F401

    return QUERIES, ORACLES
