"""Operators for preparing training corpora, and the queries that apply them."""

from tabweave.llm import bpe, decontaminate, exact_dedup, langid, near_dedup, ngrams, prefix_trie, repair, shards, simhash, substrings, toxicity, urls  # noqa: F401
from tabweave.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
