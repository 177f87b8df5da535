"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import sql
from tessera.llm.collocations import OP12_SQL, op12_collocations
from tessera.llm.decontaminate import op6_spaced_seeds
from tessera.llm.langid import op1_language_id
from tessera.llm.lexical import OP13_SQL, op13_block_max
from tessera.llm.linededup import OP7_SQL, op7_line_windows
from tessera.llm.packing import op4_cost_packing
from tessera.llm.quality import op8_quality_rules
from tessera.llm.simhash import op5_simhash_golay
from tessera.llm.store import op9_content_store
from tessera.llm.substring import op10_suffix_automata
from tessera.llm.suffixdedup import op2_suffix_merge
from tessera.llm.toxicity import op11_zstd_toxicity
from tessera.llm.urlfilter import op3_link_trust

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_merge": op2_suffix_merge,
    "op3_link_trust": op3_link_trust,
    "op4_cost_packing": op4_cost_packing,
    "op5_simhash_golay": op5_simhash_golay,
    "op6_spaced_seeds": op6_spaced_seeds,
    "op7_line_windows": op7_line_windows,
    "op8_quality_rules": op8_quality_rules,
    "op9_content_store": op9_content_store,
    "op10_suffix_automata": op10_suffix_automata,
    "op11_zstd_toxicity": op11_zstd_toxicity,
    "op12_collocations": op12_collocations,
    "op13_block_max": op13_block_max,
}
ORACLES: dict[str, str] = {
    "op2_suffix_merge": sql.SUFFIXES,
    "op3_link_trust": sql.links(),
    "op7_line_windows": OP7_SQL,
    "op8_quality_rules": sql.QUALITY,
    "op10_suffix_automata": sql.PASSAGES,
    "op12_collocations": OP12_SQL,
    "op13_block_max": OP13_SQL,
}
