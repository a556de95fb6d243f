"""The queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from .bpe import op8_bpe
from .embedding_dedup import ORACLE as EMBEDDING_DEDUP_SQL
from .embedding_dedup import op10_embedding_dedup
from .exact_dedup import ORACLE as EXACT_DEDUP_SQL
from .exact_dedup import op9_exact_dedup
from .language_id import op5_language_id
from .line_dedup import op1_line_dedup
from .minhash_dedup import op2_minhash_dedup
from .mixing import op4_raked_mixing
from .mixing import oracle as mixing_sql
from .pii import op6_pii_pseudonyms
from .ppm import op7_ppm
from .sharding import op3_feistel_sharding

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_feistel_sharding": op3_feistel_sharding,
    "op4_raked_mixing": op4_raked_mixing,
    "op5_language_id": op5_language_id,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_ppm": op7_ppm,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
}

ORACLE_SQL = {"op4_raked_mixing": mixing_sql(), "op9_exact_dedup": EXACT_DEDUP_SQL, "op10_embedding_dedup": EMBEDDING_DEDUP_SQL}
