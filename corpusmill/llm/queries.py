"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from corpusmill.llm import bpe, html, infill, langid, mixing, neighbours, quality, resampling, simhash, substrings, tokenfiles, urls, vectors

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_main_text": html.op2,
    "op3_url_filter": urls.op3,
    "op4_substrings": substrings.op4,
    "op5_token_files": tokenfiles.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_quality": quality.op7,
    "op8_simhash": simhash.op8,
    "op9_language": langid.op9,
    "op10_neighbours": neighbours.op10,
    "op11_infill": infill.op11,
    "op12_resampling": resampling.op12,
    "op13_vectors": vectors.op13,
}
ORACLES = {
    "op1_mixing": mixing.SQL,
    "op4_substrings": substrings.SQL,
    "op7_quality": quality.SQL,
    "op11_infill": infill.SQL,
    "op12_resampling": resampling.SQL,
    "op13_vectors": vectors.SQL,
}
