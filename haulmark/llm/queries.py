"""The registered queries of this subpackage. Importing the modules below fills both tables."""

from __future__ import annotations

from haulmark.llm import q_decontaminate, q_fixity, q_langid, q_packing, q_pii, q_pipeline, q_simhash, q_suffix_dedup, q_token_files, q_topk, q_url_filter

MODULES = [q_token_files, q_topk, q_fixity, q_decontaminate, q_langid, q_url_filter, q_simhash, q_packing, q_pii, q_suffix_dedup, q_pipeline]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}
