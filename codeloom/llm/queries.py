"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from codeloom.llm.fill_middle import OP12_SQL, op12_fill_middle
from codeloom.llm.graph_index import op3_graph_index
from codeloom.llm.lookup_sketch import op4_lookup_sketch
from codeloom.llm.mixing import op8_mix_sources
from codeloom.llm.ngram_join import op2_ngram_join
from codeloom.llm.piece_fst import op7_piece_fst
from codeloom.llm.pii import op9_personal_data
from codeloom.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from codeloom.llm.secrets import op10_secret_scan
from codeloom.llm.token_store import op5_token_store
from codeloom.llm.toxicity import op1_toxicity
from codeloom.llm.url_filter import OP6_SQL, op6_url_filter
from codeloom.llm.zip_warc import OP11_SQL, op11_zip_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_ngram_join, op3_graph_index, op4_lookup_sketch, op5_token_store, op6_url_filter, op7_piece_fst, op8_mix_sources,
        op9_personal_data, op10_secret_scan, op11_zip_warc, op12_fill_middle, op13_prefix_trie,
    )
}
ORACLES: dict[str, str] = {"op6_url_filter": OP6_SQL, "op11_zip_warc": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
