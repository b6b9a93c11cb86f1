"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op5_chat_formatting
from .decontam import op3_decontamination
from .lm import op2_lm_scoring
from .media import op8_media_columns
from .mixing import op13_source_mixing
from .names import ORACLE as NAMES_SQL
from .names import op11_name_join
from .neardup import op4_minhash_dedup
from .oracle import NEAR_DUPLICATES, REPEATS
from .pieces import op1_sentencepiece
from .quality import op10_quality_classifier
from .search import ORACLE as SEARCH_SQL
from .search import op12_lexical_search
from .sharding import op6_sharding
from .substring import op7_substring_dedup
from .toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_sharding": op6_sharding,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_media_columns": op8_media_columns,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_name_join": op11_name_join,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_mixing": op13_source_mixing,
}

#: DuckDB SQL where it can express the whole result.
ORACLE: dict[str, str] = {"op4_minhash_dedup": NEAR_DUPLICATES, "op7_substring_dedup": REPEATS, "op11_name_join": NAMES_SQL, "op12_lexical_search": SEARCH_SQL}
