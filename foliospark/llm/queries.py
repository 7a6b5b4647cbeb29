"""Registered queries of the ten operators and of the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, lm, materialise, mixing, neardup, search, sharding, suffixes, toxicity, urls

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_url_filters": urls.query,
    "op2_training_order": materialise.query,
    "op3_decontamination": decontaminate.query,
    "op4_near_dedup": neardup.query,
    "op5_maxscore_search": search.query,
    "op6_toxicity": toxicity.query,
    "op7_suffix_dedup": suffixes.query,
    "op8_sharding": sharding.query,
    "op9_lm_scoring": lm.query,
    "op10_mixing": mixing.query,
}

#: The other operators have no SQL form; tests/llm compares them with brute force.
ORACLE = {"op5_maxscore_search": search.SQL, "op8_sharding": sharding.SQL, "op10_mixing": mixing.SQL}
