"""The named queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .ann import op6_adaptive_scan
from .chat import OP11_SQL, op11_schema_prints
from .divergence import OP13_SQL, op13_perfect_recount
from .fingerprints import op2_digest
from .html import op5_main_text
from .licenses import op3_notices
from .mixing import OP8_SQL, op8_min_cost_mix
from .neardup import op7_dartminhash
from .packing import op10_best_fit
from .repair import OP12_SQL, op12_edit_lattice
from .sentences import OP4_SQL, op4_sentence_spans
from .sharding import OP1_SQL, op1_interleave
from .toxicity import op9_subwords

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_interleave": op1_interleave,
    "op2_digest": op2_digest,
    "op3_notices": op3_notices,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_main_text": op5_main_text,
    "op6_adaptive_scan": op6_adaptive_scan,
    "op7_dartminhash": op7_dartminhash,
    "op8_min_cost_mix": op8_min_cost_mix,
    "op9_subwords": op9_subwords,
    "op10_best_fit": op10_best_fit,
    "op11_schema_prints": op11_schema_prints,
    "op12_edit_lattice": op12_edit_lattice,
    "op13_perfect_recount": op13_perfect_recount,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_interleave": OP1_SQL,
    "op4_sentence_spans": OP4_SQL,
    "op8_min_cost_mix": OP8_SQL,
    "op11_schema_prints": OP11_SQL,
    "op12_edit_lattice": OP12_SQL,
    "op13_perfect_recount": OP13_SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
