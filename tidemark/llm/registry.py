"""Queries of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm.bpe import op4_bpe
from tidemark.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from tidemark.llm.decontaminate import op8_decontamination
from tidemark.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tidemark.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from tidemark.llm.language_id import op3_language_id
from tidemark.llm.line_dedup import op2_line_dedup
from tidemark.llm.ngram_join import OP10_SQL, op10_ngram_join
from tidemark.llm.packing import op12_packing
from tidemark.llm.passages import op7_passages
from tidemark.llm.quality import op5_quality
from tidemark.llm.token_tables import op9_token_tables
from tidemark.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_passages": op7_passages,
    "op8_decontamination": op8_decontamination,
    "op9_token_tables": op9_token_tables,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op6_warc": OP6_SQL,
    "op10_ngram_join": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
