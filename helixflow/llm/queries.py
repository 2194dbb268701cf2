"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat_format import OP3_SQL, op3_chat_format
from .decontaminate import op9_decontaminate
from .html_extract import op5_html_text
from .jaccard_join import op1_jaccard_join
from .language_id import op7_language_id
from .mixing import op4_mixing
from .periodic_runs import op12_periodic_runs
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import op10_quality
from .simhash import op13_simhash
from .suffix_lm import op2_suffix_lm
from .token_count import op8_token_count
from .url_filter import op6_url_filter

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_suffix_lm": op2_suffix_lm,
    "op3_chat_format": op3_chat_format,
    "op4_mixing": op4_mixing,
    "op5_html_text": op5_html_text,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_token_count": op8_token_count,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash": op13_simhash,
}

ORACLE_SQL = {
    "op3_chat_format": OP3_SQL,
    "op11_prefix_trie": OP11_SQL,
}
