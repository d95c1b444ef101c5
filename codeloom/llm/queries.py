"""The registered queries of this package and the SQL for those that SQL can express."""

from codeloom.llm import pipeline
from codeloom.llm.bpe import op5_bpe
from codeloom.llm.chat import OP10_SQL, op10_chat_format
from codeloom.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from codeloom.llm.language_id import op11_language_id
from codeloom.llm.licenses import op6_license_scan
from codeloom.llm.minhash import op4_minhash
from codeloom.llm.packing import op7_pack
from codeloom.llm.ranked import OP13_SQL, op13_ranked_search
from codeloom.llm.sharding import op9_extendible_sharding
from codeloom.llm.simhash import op3_simhash
from codeloom.llm.suffix_dedup import op1_suffix_dedup
from codeloom.llm.toxicity import op8_toxicity
from codeloom.llm.voronoi import OP2_SQL, op2_voronoi_topk

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_voronoi_topk": op2_voronoi_topk,
    "op3_simhash": op3_simhash,
    "op4_minhash": op4_minhash,
    "op5_bpe": op5_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_pack": op7_pack,
    "op8_toxicity": op8_toxicity,
    "op9_extendible_sharding": op9_extendible_sharding,
    "op10_chat_format": op10_chat_format,
    "op11_language_id": op11_language_id,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": pipeline.run,
}

ORACLE_SQL = {"op2_voronoi_topk": OP2_SQL, "op10_chat_format": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_ranked_search": OP13_SQL}
