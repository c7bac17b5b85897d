"""Registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL.

Each runs its operator over the whole intended table with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import licenses, resampling, urls
from tessera.llm.alignment import op13_alignment
from tessera.llm.bpe import op12_bpe
from tessera.llm.chat import op8_chat
from tessera.llm.common import table
from tessera.llm.decontam import op5_decontamination
from tessera.llm.langid import op1_langid
from tessera.llm.media import op2_media, page_items
from tessera.llm.packing import op3_packing
from tessera.llm.pii import op9_pii
from tessera.llm.simhash import op10_simhash
from tessera.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": lambda s, d: op1_langid(table(s, d, "documents")),
    "op2_media": op2_media,
    "page_items": page_items,
    "op3_packing": lambda s, d: op3_packing(table(s, d, "documents")),
    "op4_urls": urls.op4_urls,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_licenses": licenses.op7_licenses,
    "op8_chat": op8_chat,
    "op9_pii": lambda s, d: op9_pii(table(s, d, "documents")),
    "op10_simhash": lambda s, d: op10_simhash(table(s, d, "documents")),
    "op11_resampling": resampling.op11_resampling,
    "op12_bpe": lambda s, d: op12_bpe(table(s, d, "documents")),
    "op13_alignment": lambda s, d: op13_alignment(table(s, d, "documents")),
}

ORACLE: dict[str, str] = {"op4_urls": urls.ORACLE, "op7_licenses": licenses.ORACLE, "op11_resampling": resampling.ORACLE}
