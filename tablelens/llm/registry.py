"""All queries of this subpackage, imported for their registration side effect."""

from tablelens.llm import (  # noqa: F401
    chat, decontaminate, html_template, importance, merkle, minhash, quality, sentencepiece_sampling, sharding, simhash, tokenids,
    toxicity, urlfilter)
from tablelens.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
