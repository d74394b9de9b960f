"""Registry of this subpackage's queries and their SQL."""

from ledgerline.llm.bpe import op1_byte_bpe
from ledgerline.llm.decontaminate import OP9_SQL, op9_decontaminate
from ledgerline.llm.flac import op4_flac
from ledgerline.llm.html_text import op6_html_text
from ledgerline.llm.lm_scoring import op3_pitman_yor
from ledgerline.llm.quality import op7_quality
from ledgerline.llm.secrets import op10_secrets
from ledgerline.llm.simhash import op2_simhash
from ledgerline.llm.suffixes import OP5_SQL, op5_suffix_dedup
from ledgerline.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_flac": op4_flac,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_html_text": op6_html_text,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_secrets": op10_secrets,
}
ORACLES = {"op5_suffix_dedup": OP5_SQL, "op8_warc": OP8_SQL, "op9_decontaminate": OP9_SQL}
