"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from basinflow.llm.bpe import op9_bpe
from basinflow.llm.html_text import op10_html_text
from basinflow.llm.language import op8_language
from basinflow.llm.lines import OP11_SQL, op11_line_dedup
from basinflow.llm.manifest import OP12_SQL, op12_merkle_manifest
from basinflow.llm.packing import op5_packing
from basinflow.llm.pii import op7_pii
from basinflow.llm.quality import op3_suffix_quality
from basinflow.llm.search import OP2_SQL, op2_topk_search
from basinflow.llm.sharding import OP4_SQL, op4_extendible_hash
from basinflow.llm.simhash import op1_simhash
from basinflow.llm.substrings import op6_suffix_dedup
from basinflow.llm.whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_topk_search,
        op3_suffix_quality,
        op4_extendible_hash,
        op5_packing,
        op6_suffix_dedup,
        op7_pii,
        op8_language,
        op9_bpe,
        op10_html_text,
        op11_line_dedup,
        op12_merkle_manifest,
        op13_embedding_whitening,
    )
}

SQL = {"op2_topk_search": OP2_SQL, "op4_extendible_hash": OP4_SQL, "op11_line_dedup": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
