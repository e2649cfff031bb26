"""Queries of this subpackage by name."""

from __future__ import annotations

from graphloom.llm.audit import op13_filter_audit
from graphloom.llm.bpe import op7_bpe
from graphloom.llm.jaccard import op2_jaccard_join
from graphloom.llm.licences import op5_licence_scan
from graphloom.llm.neighbours import op10_embedding_dedup
from graphloom.llm.oracles import SQL
from graphloom.llm.packing import op3_packing
from graphloom.llm.pages import op1_html_extraction
from graphloom.llm.pii import op6_pii
from graphloom.llm.quality import op8_quality_rules
from graphloom.llm.resampling import op11_importance_resampling
from graphloom.llm.sharding import op4_sharding
from graphloom.llm.suffixes import op9_suffix_dedup
from graphloom.llm.url_filters import op12_url_filters


def _pipeline(spark, sf_dir):
    import corpus_pipeline  # it imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (
        op1_html_extraction,
        op2_jaccard_join,
        op3_packing,
        op4_sharding,
        op5_licence_scan,
        op6_pii,
        op7_bpe,
        op8_quality_rules,
        op9_suffix_dedup,
        op10_embedding_dedup,
        op11_importance_resampling,
        op12_url_filters,
        op13_filter_audit,
    )
    return {f.__name__: f for f in found} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
