"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from . import ctph, interleave, langid, mixing, packing, quality, simhash, toxicity, voronoi, warc

QUERIES = {
    "op1_warc_revisits": warc.op1_warc_revisits,
    "op2_language": langid.op2_language,
    "language_of_documents": langid.documents_language,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_pack": packing.op4_pack,
    "packed_in_limits": packing.packed_in_limits,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash": simhash.op6_simhash,
    "op7_pu_quality": quality.op7_pu_quality,
    "op8_ctph": ctph.op8_ctph,
    "op9_interleaved_shards": interleave.op9_interleaved_shards,
    "op10_voronoi_top_k": voronoi.op10_voronoi_top_k,
}
ORACLE_SQL = {"op1_warc_revisits": warc.OP1_SQL, "op3_mix_sources": mixing.OP3_SQL, "op10_voronoi_top_k": voronoi.OP10_SQL}
