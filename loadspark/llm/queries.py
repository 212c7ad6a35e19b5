"""All queries of this folder; importing the modules registers them."""

from loadspark.llm import (  # noqa: F401
    bpe_tokens,
    license_scan,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    repeated_text,
    secret_scan,
    sentence_pieces,
    sharding,
    token_alignment,
    vector_codes,
    vector_dedup,
)
from loadspark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
