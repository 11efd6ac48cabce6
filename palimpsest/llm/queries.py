"""The queries of this subpackage, by name, and the SQL that tells their rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.jaccard import OP10_SQL, op10_jaccard
from palimpsest.llm.language import op1_language
from palimpsest.llm.licenses import op4_licenses
from palimpsest.llm.media import op5_media
from palimpsest.llm.mixing import op8_mixing
from palimpsest.llm.packing import op9_packing
from palimpsest.llm.quality import op2_quality
from palimpsest.llm.sharding import op7_sharding
from palimpsest.llm.topk import OP3_SQL, op3_topk
from palimpsest.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_topk": op3_topk,
    "op4_licenses": op4_licenses,
    "op5_media": op5_media,
    "op6_warc": op6_warc,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_jaccard": op10_jaccard,
}

ORACLES: dict[str, str] = {"op3_topk": OP3_SQL, "op6_warc": OP6_SQL, "op10_jaccard": OP10_SQL}
