"""The queries of this subpackage: name -> f(spark, sf_dir), and their DuckDB
SQL where SQL can express them."""

from __future__ import annotations

from parityframe.llm.bpe import op5_byte_bpe
from parityframe.llm.decontamination import OP1_SQL, op1_decontamination
from parityframe.llm.fingerprints import op10_fingerprints
from parityframe.llm.licenses import op9_license_scan
from parityframe.llm.lines import OP3_SQL, op3_line_dedup
from parityframe.llm.ngram_join import OP2_SQL, op2_ngram_jaccard
from parityframe.llm.packing import op8_packed_tokens
from parityframe.llm.piececounts import op4_token_counts
from parityframe.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from parityframe.llm.repair import op13_structure_repair
from parityframe.llm.substrings import OP7_SQL, op7_substring_dedup
from parityframe.llm.toxicity import op6_toxicity
from parityframe.llm.urlfilter import OP11_SQL, op11_url_filter

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packed_tokens": op8_packed_tokens,
    "op9_license_scan": op9_license_scan,
    "op10_fingerprints": op10_fingerprints,
    "op11_url_filter": op11_url_filter,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}

ORACLE = {
    "op1_decontamination": OP1_SQL,
    "op2_ngram_jaccard": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op11_url_filter": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
