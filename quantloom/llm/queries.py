"""The queries of this subpackage and the SQL that DuckDB answers them with."""

from __future__ import annotations

from quantloom.llm.collocations import OP13_SQL, op13_phrase_collocations
from quantloom.llm.decontaminate import OP6_SQL, op6_decontamination
from quantloom.llm.fingerprints import op12_simhash
from quantloom.llm.jaccard import op5_ngram_jaccard
from quantloom.llm.lines import op8_line_templates
from quantloom.llm.packing import op2_best_fit_packing
from quantloom.llm.pii import op10_personal_data
from quantloom.llm.quality import OP3_SQL, op3_quality_rules
from quantloom.llm.resampling import OP11_SQL, op11_importance_resampling
from quantloom.llm.substring import op4_repeated_phrases
from quantloom.llm.suffix_array import op9_repeated_bytes
from quantloom.llm.url_filter import OP7_SQL, op7_url_filter
from quantloom.llm.warc import op1_warc_dictionary

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_dictionary,
        op2_best_fit_packing,
        op3_quality_rules,
        op4_repeated_phrases,
        op5_ngram_jaccard,
        op6_decontamination,
        op7_url_filter,
        op8_line_templates,
        op9_repeated_bytes,
        op10_personal_data,
        op11_importance_resampling,
        op12_simhash,
        op13_phrase_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op6_decontamination": OP6_SQL, "op7_url_filter": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
