"""The corpus queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from quillon.llm import oracles
from quillon.llm.ann import op2_query
from quillon.llm.language import op13_query
from quillon.llm.line_dedup import op8_query
from quillon.llm.mixing import op7_query
from quillon.llm.ngram_join import op4_query
from quillon.llm.periodic import op12_query
from quillon.llm.pieces import op10_query
from quillon.llm.quality import op3_query
from quillon.llm.resample import op11_query
from quillon.llm.secret_crf import op1_query
from quillon.llm.sharding import op9_query
from quillon.llm.toxicity import op5_query
from quillon.llm.warc import op6_query


def queries() -> dict:
    return {
        "op1_secret_scan": op1_query,
        "op2_nearest_neighbours": op2_query,
        "op3_quality_rules": op3_query,
        "op4_ngram_join": op4_query,
        "op5_toxicity": op5_query,
        "op6_warc": op6_query,
        "op7_mixing": op7_query,
        "op8_line_dedup": op8_query,
        "op9_sharding": op9_query,
        "op10_sentencepiece": op10_query,
        "op11_importance_resampling": op11_query,
        "op12_periodic_runs": op12_query,
        "op13_language": op13_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": oracles.op3(),
        "op4_ngram_join": oracles.op4(),
        "op6_warc": oracles.op6(),
        "op7_mixing": oracles.op7(),
        "op9_sharding": oracles.op9(),
        "op11_importance_resampling": oracles.op11(),
        "op12_periodic_runs": oracles.op12(),
    }
