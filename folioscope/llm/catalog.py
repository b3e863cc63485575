"""Imports every module of this subpackage that registers queries."""

from folioscope.llm import conversation_trie, hidden_markov, kd_shards, language, licence_scan, maxscore, packing, periodic_runs, piece_transducer, quality_rules, shingle_join, token_counts, toxicity  # noqa: F401
from folioscope.llm.registry import ORACLES, QUERIES  # noqa: F401
