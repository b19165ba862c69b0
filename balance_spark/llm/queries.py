"""The registered queries of the corpus operators, and their SQL twins."""

from __future__ import annotations

from balance_spark.llm.chat import OP10_SQL, op10_chat
from balance_spark.llm.decontam import op9_decontamination
from balance_spark.llm.lexical import OP12_SQL, op12_lexical
from balance_spark.llm.linededup import OP6_SQL, op6_lines
from balance_spark.llm.packing import op4_packing
from balance_spark.llm.pieces import op11_pieces
from balance_spark.llm.quality import OP3_SQL, op3_quality
from balance_spark.llm.simhash import op5_simhash
from balance_spark.llm.suffixes import OP2_SQL, op2_suffixes
from balance_spark.llm.tokenpack import op7_tokens
from balance_spark.llm.toxicity import op1_toxicity
from balance_spark.llm.warc import OP8_SQL, op8_warc
from balance_spark.llm.whitening import op13_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_suffixes": op2_suffixes,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_lines": op6_lines,
    "op7_tokens": op7_tokens,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "op11_pieces": op11_pieces,
    "op12_lexical": op12_lexical,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op2_suffixes": OP2_SQL,
    "op3_quality": OP3_SQL,
    "op6_lines": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op10_chat": OP10_SQL,
    "op12_lexical": OP12_SQL,
}
