"""Queries and SQL of the numbered problems."""

from __future__ import annotations

from quillspark.llm import encodings, leaks, lookalikes, neighbours, scans, site_lines, splitting, tokens, truncation

QUERIES = {
    "p1_found": splitting.p1_found,
    "p1_pieces": splitting.p1_pieces,
    "p2_found": lookalikes.p2_found,
    "p2_forms": lookalikes.p2_forms,
    "p3_found": site_lines.p3_found,
    "p3_lines": site_lines.p3_lines,
    "p3_disagreements": site_lines.p3_disagreements,
    "p3_clean": site_lines.p3_clean,
    "p4_found": neighbours.p4_found,
    "p4_neighbours": neighbours.p4_neighbours,
    "p5_found": scans.p5_found,
    "p5_paragraphs": scans.p5_paragraphs,
    "p6_found": encodings.p6_found,
    "p6_restored": encodings.p6_restored,
    "p7_ids": tokens.p7_ids,
    "p8_found": leaks.p8_found,
    "p8_report": leaks.p8_report,
    "p9_found": truncation.p9_found,
    "p9_sources": truncation.p9_sources,
}

SQL = {"p1_found": splitting.P1_FOUND_SQL, "p3_found": site_lines.P3_FOUND_SQL}
