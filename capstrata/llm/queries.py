"""The queries of this subpackage, by name, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from capstrata.llm.bestfit import op12_bestfit
from capstrata.llm.chat import OP4_SQL, op4_chat
from capstrata.llm.ctw import op5_ctw
from capstrata.llm.decontaminate import OP3_SQL, op3_decontaminate
from capstrata.llm.fim import OP11_SQL, op11_fim
from capstrata.llm.langid import op9_langid
from capstrata.llm.packing import op7_packing
from capstrata.llm.quality import op6_quality
from capstrata.llm.secrets import op10_secrets
from capstrata.llm.simhash import op2_simhash
from capstrata.llm.spelling import OP13_SQL, op13_spelling
from capstrata.llm.urls import OP1_SQL, op1_urls
from capstrata.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_urls": op1_urls,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat": op4_chat,
    "op5_ctw": op5_ctw,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_langid": op9_langid,
    "op10_secrets": op10_secrets,
    "op11_fim": op11_fim,
    "op12_bestfit": op12_bestfit,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {
    "op1_urls": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_chat": OP4_SQL,
    "op8_warc": OP8_SQL,
    "op11_fim": OP11_SQL,
    "op13_spelling": OP13_SQL,
}
