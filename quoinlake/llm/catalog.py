"""Registered queries of the training-data operators, with the SQL that checks them."""

from quoinlake.llm.chat import CHAT_SQL, chat_query
from quoinlake.llm.decontaminate import decontamination_query
from quoinlake.llm.extraction import extraction_query
from quoinlake.llm.jaccard import jaccard_query
from quoinlake.llm.merkle import MERKLE_SQL, merkle_query
from quoinlake.llm.pieces import pieces_query
from quoinlake.llm.pii import pii_query
from quoinlake.llm.quality import quality_query
from quoinlake.llm.sampling import fingerprint_query
from quoinlake.llm.spelling import SPELLING_SQL, spelling_query
from quoinlake.llm.token_file import token_query
from quoinlake.llm.url_filter import url_query
from quoinlake.llm.warc import WARC_SQL, warc_query

QUERIES = {
    "op1_quality": quality_query,
    "op2_chat_format": chat_query,
    "op3_pieces": pieces_query,
    "op4_warc": warc_query,
    "op5_jaccard_join": jaccard_query,
    "op6_pii": pii_query,
    "op7_token_file": token_query,
    "op8_fingerprints": fingerprint_query,
    "op9_decontamination": decontamination_query,
    "op10_html_text": extraction_query,
    "op11_spelling": spelling_query,
    "op12_merkle": merkle_query,
    "op13_url_filter": url_query,
}
SQL = {"op2_chat_format": CHAT_SQL, "op4_warc": WARC_SQL, "op11_spelling": SPELLING_SQL, "op12_merkle": MERKLE_SQL}
