"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumlake.llm.bpe import op1_byte_bpe
from quorumlake.llm.embedding_dedup import OP8_SQL, op8_embedding_dedup
from quorumlake.llm.jaccard_join import OP6_SQL, op6_jaccard_join
from quorumlake.llm.language_id import op3_language_id
from quorumlake.llm.log_reassembly import OP11_SQL, op11_log_reassembly
from quorumlake.llm.mixing import OP10_SQL, op10_mixing
from quorumlake.llm.pii import op9_pii
from quorumlake.llm.repeats import OP5_SQL, op5_repeated_strings
from quorumlake.llm.secrets import op4_secret_scan
from quorumlake.llm.syncmers import op7_fingerprints
from quorumlake.llm.token_files import op2_token_files
from quorumlake.llm.toxicity import op12_toxicity
from quorumlake.llm.whitening import op13_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_byte_bpe, op2_token_files, op3_language_id, op4_secret_scan, op5_repeated_strings, op6_jaccard_join, op7_fingerprints, op8_embedding_dedup, op9_pii, op10_mixing, op11_log_reassembly, op12_toxicity, op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_repeated_strings": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op10_mixing": OP10_SQL, "op8_embedding_dedup": OP8_SQL, "op11_log_reassembly": OP11_SQL}
