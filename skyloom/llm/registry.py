"""Queries of the corpus operators, by name."""

from __future__ import annotations

from skyloom.llm import align, html, licenses, lm, media, mixing, neardup, packing, pii, quality, repeats, trie, warc

QUERIES = {
    "op1_html": html.op1_html,
    "op2_quality": quality.op2_quality,
    "op3_lm": lm.op3_lm,
    "op4_pii": pii.op4_pii,
    "op5_packing": packing.op5_packing,
    "op6_neardup": neardup.op6_neardup,
    "op7_media": media.op7_media,
    "op8_repeats": repeats.op8_repeats,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "op11_trie": trie.op11_trie,
    "op12_align": align.op12_align,
    "op13_licenses": licenses.op13_licenses,
}

ORACLES: dict[str, str] = {
    "op2_quality": quality.SQL,
    "op6_neardup": neardup.SQL,
    "op9_warc": warc.SQL,
    "op11_trie": trie.SQL,
}
