"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from assayer.llm.alignments import op13_alignments
from assayer.llm.codebooks import OP11_SQL, op11_codebooks
from assayer.llm.hosts import OP9_SQL, op9_hosts
from assayer.llm.language import op6_language
from assayer.llm.media import op8_media
from assayer.llm.mixing import OP5_SQL, op5_mixing
from assayer.llm.neardup import op4_neardup
from assayer.llm.personal import op10_personal
from assayer.llm.pieces import op1_pieces
from assayer.llm.secrets import op2_secrets
from assayer.llm.simhash import op12_simhash
from assayer.llm.tokens import op7_tokens
from assayer.llm.topk import OP3_SQL, op3_topk

QUERIES = {"op1_pieces": op1_pieces, "op2_secrets": op2_secrets, "op3_topk": op3_topk, "op4_neardup": op4_neardup, "op5_mixing": op5_mixing, "op6_language": op6_language, "op7_tokens": op7_tokens, "op8_media": op8_media, "op9_hosts": op9_hosts, "op10_personal": op10_personal, "op11_codebooks": op11_codebooks, "op12_simhash": op12_simhash, "op13_alignments": op13_alignments}
ORACLE_SQL = {"op3_topk": OP3_SQL, "op5_mixing": OP5_SQL, "op9_hosts": OP9_SQL, "op11_codebooks": OP11_SQL}
