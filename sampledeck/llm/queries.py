"""The queries of this subpackage, and SQL for those that SQL can express."""

from .bpe import op13_byte_bpe
from .ctw import op3_ctw_score
from .decontam import OP6_SQL, op6_contained_items
from .lines import OP10_SQL, op10_line_dedup
from .packing import op5_pack_pieces
from .quality import op7_quality_scores
from .rabitq import OP1_SQL, op1_embedding_links
from .ranked import OP11_SQL, op11_ranked_search
from .simhash import op4_simhash_groups
from .suffixes import op8_remove_repeats
from .tokenfile import op9_token_files
from .trie import OP12_SQL, op12_prefix_trie
from .warc import OP2_SQL, op2_warc_captures

QUERIES = {
    "op1_embedding_links": op1_embedding_links,
    "op2_warc_captures": op2_warc_captures,
    "op3_ctw_score": op3_ctw_score,
    "op4_simhash_groups": op4_simhash_groups,
    "op5_pack_pieces": op5_pack_pieces,
    "op6_contained_items": op6_contained_items,
    "op7_quality_scores": op7_quality_scores,
    "op8_remove_repeats": op8_remove_repeats,
    "op9_token_files": op9_token_files,
    "op10_line_dedup": op10_line_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES = {"op1_embedding_links": OP1_SQL, "op2_warc_captures": OP2_SQL, "op6_contained_items": OP6_SQL, "op10_line_dedup": OP10_SQL, "op11_ranked_search": OP11_SQL, "op12_prefix_trie": OP12_SQL}
