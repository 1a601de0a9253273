"""The queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, conversations, neighbours
from .collocations import op13_collocations
from .conversations import op12_conversations
from .decontaminate import op9_decontamination
from .langid import op7_language
from .neighbours import op11_neighbours
from .packing import op4_packing
from .pii import op3_personal_data
from .quality import op10_quality
from .simhash import op2_simhash
from .substrings import op8_substrings
from .suffix_dedup import op6_suffix_array
from .token_output import op5_token_output
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_personal_data, op4_packing, op5_token_output, op6_suffix_array, op7_language, op8_substrings, op9_decontamination, op10_quality, op11_neighbours, op12_conversations, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op11_neighbours": neighbours.SQL, "op12_conversations": conversations.SQL, "op13_collocations": collocations.SQL}
