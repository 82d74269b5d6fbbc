"""The queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from shelfspark.llm import (bpe_codec, decontamination, embedding_dedup, fill_in_middle, hard_negatives, jaccard_join, language_id, line_dedup, pii,
                            substring_dedup, suffix_dedup, token_counts, token_file)

MODULES = (language_id, pii, line_dedup, decontamination, suffix_dedup, jaccard_join, bpe_codec, token_counts, embedding_dedup, token_file,
           substring_dedup, hard_negatives, fill_in_middle)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
