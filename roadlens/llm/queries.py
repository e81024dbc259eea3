"""Queries of this subpackage by name, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from roadlens.llm.density import op2_density
from roadlens.llm.line_dedup import op7_line_dedup
from roadlens.llm.mixing import op3_mixing
from roadlens.llm.ngram_join import op6_ngram_join
from roadlens.llm.packing import op10_packing
from roadlens.llm.pii import op4_pii
from roadlens.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from roadlens.llm.quality import OP5_SQL, op5_quality
from roadlens.llm.simhash import op12_simhash
from roadlens.llm.spelling import OP13_SQL, op13_spelling
from roadlens.llm.substring import OP9_SQL, op9_substring
from roadlens.llm.topk import OP8_SQL, op8_topk
from roadlens.llm.warc import OP1_SQL, op1_warc
from roadlens.llm.ngram_join import OP6_SQL

QUERIES = {
    "op1_warc": op1_warc,
    "op2_density": op2_density,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_topk": op8_topk,
    "op9_substring": op9_substring,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op5_quality": OP5_SQL,
    "op6_ngram_join": OP6_SQL,
    "op8_topk": OP8_SQL,
    "op9_substring": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_spelling": OP13_SQL,
}
