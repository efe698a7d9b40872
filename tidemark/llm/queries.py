"""Queries of the corpus operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tidemark.llm.conversation import OP11_SQL, op11_conversation_repair
from tidemark.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from tidemark.llm.jaccard import op6_ngram_jaccard
from tidemark.llm.minhash import op12_minhash
from tidemark.llm.mixing import op5_source_mixing
from tidemark.llm.ngram_lm import op10_lm_scoring
from tidemark.llm.pieces_codec import op3_sentencepiece
from tidemark.llm.pii import op8_pii
from tidemark.llm.quality import op4_quality_rules
from tidemark.llm.runs import op13_periodic_runs
from tidemark.llm.suffix_dedup import op1_suffix_dedup
from tidemark.llm.url_filter import OP9_SQL, op9_url_filter
from tidemark.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_rules": op4_quality_rules,
    "op5_source_mixing": op5_source_mixing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_url_filter": op9_url_filter,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_minhash": op12_minhash,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL = {"op2_exact_dedup": OP2_SQL, "op7_warc": OP7_SQL, "op9_url_filter": OP9_SQL, "op11_conversation_repair": OP11_SQL}
