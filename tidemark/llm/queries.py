"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from tidemark.llm import decontaminate, fixity, lines, lexical, minhash, phrases, pieces, quality, rangecoder, simhash, spotsigs, suffixes, urls

QUERIES = {
    "op1_spotsigs": spotsigs.op1_spotsigs,
    "op2_url_filter": urls.op2_url_filter,
    "op3_simhash": simhash.op3_simhash,
    "op4_warc_fixity": fixity.op4_warc_fixity,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_range_coder": rangecoder.op9_range_coder,
    "op10_quality": quality.op10_quality,
    "op11_minhash": minhash.op11_minhash,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_collocations": phrases.op13_collocations,
}
SQL = {"op2_url_filter": urls.OP2_SQL, "op4_warc_fixity": fixity.OP4_SQL, "op11_minhash": minhash.OP11_SQL, "op12_lexical_search": lexical.OP12_SQL, "op13_collocations": phrases.OP13_SQL}
