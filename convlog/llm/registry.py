"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from convlog.llm.alignment import op13_tokenizer_alignment
from convlog.llm.byte_bpe import op5_byte_bpe
from convlog.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from convlog.llm.line_dedup import op1_line_dedup
from convlog.llm.mixing import op2_mixing
from convlog.llm.ngram_join import op8_ngram_join
from convlog.llm.quality import op3_quality
from convlog.llm.substring_dedup import op9_substring_dedup
from convlog.llm.suffix_dedup import op12_suffix_dedup
from convlog.llm.token_output import op6_token_output
from convlog.llm.topk_search import OP10_SQL, op10_topk_search
from convlog.llm.toxicity import op4_toxicity
from convlog.llm.whitening import op11_whitening

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_output": op6_token_output,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_topk_search": op10_topk_search,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL = {
    "op7_exact_dedup": OP7_SQL,
    "op10_topk_search": OP10_SQL,
}
