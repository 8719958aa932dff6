"""The queries of this subpackage and their SQL, for the entry module."""

from lexiforge.llm import decontam, hnsw, htmltext, langid, lexsearch, licenses, linededup, media, mixing, packing, pii, simhash, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_licenses": licenses.op2_licenses,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_nearest": hnsw.op4_nearest,
    "op5_simhash": simhash.op5_simhash,
    "op6_langid": langid.op6_langid,
    "op7_main_text": htmltext.op7_main_text,
    "op8_packing": packing.op8_packing,
    "op9_media": media.op9_media,
    "op10_pii": pii.op10_pii,
    "op11_decontaminate": decontam.op11_decontaminate,
    "op12_search": lexsearch.op12_search,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_licenses": licenses.OP2_SQL,
    "op11_decontaminate": decontam.OP11_SQL,
    "op12_search": lexsearch.OP12_SQL,
}
