"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe_codec import op8_bpe_codec
from .collocations import OP12_SQL, op12_collocations
from .embedding_dedup import OP10_SQL, op10_embedding_dedup
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .html_extract import op6_html_extract
from .jaccard_join import OP9_SQL, op9_jaccard_join
from .mixing import op5_mixing
from .pii import op4_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .suffix_dedup import OP11_SQL, op11_suffix_dedup
from .token_counts import op1_token_counts
from .toxicity import op2_toxicity
from .url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_toxicity, op3_exact_dedup, op4_pii, op5_mixing, op6_html_extract, op7_url_filter, op8_bpe_codec, op9_jaccard_join, op10_embedding_dedup, op11_suffix_dedup, op12_collocations, op13_prefix_trie)
}

ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op7_url_filter": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op10_embedding_dedup": OP10_SQL, "op11_suffix_dedup": OP11_SQL, "op12_collocations": OP12_SQL, "op13_prefix_trie": OP13_SQL}
