"""All queries of this subpackage; importing the modules registers them."""

from tessera.llm import (  # noqa: F401
    byte_bpe,
    divergence,
    embedding_dedup,
    fill_middle,
    language,
    line_dedup,
    packing,
    quality,
    sharding,
    simhash_dedup,
    token_files,
    url_filter,
    warc,
)
from tessera.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
