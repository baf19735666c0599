"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from cinegraph.llm import collocations, exact_dedup, license_scan, spelling, url_filter
from cinegraph.llm.bpe import op12_bpe
from cinegraph.llm.collocations import op13_collocations
from cinegraph.llm.decontaminate import op9_decontaminate
from cinegraph.llm.exact_dedup import op3_exact_dedup
from cinegraph.llm.license_scan import op10_license_scan
from cinegraph.llm.line_dedup import op8_line_dedup
from cinegraph.llm.packing import op6_packing
from cinegraph.llm.quality import op4_quality
from cinegraph.llm.simhash import op2_simhash
from cinegraph.llm.spelling import op11_spelling
from cinegraph.llm.token_counts import op7_token_counts
from cinegraph.llm.toxicity import op5_toxicity
from cinegraph.llm.url_filter import op1_url_filter

QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_simhash, op3_exact_dedup, op4_quality, op5_toxicity, op6_packing, op7_token_counts,
    op8_line_dedup, op9_decontaminate, op10_license_scan, op11_spelling, op12_bpe, op13_collocations)}

# The others can't be put into SQL; the README says what each is tested against.
ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op10_license_scan": license_scan.SQL,
    "op11_spelling": spelling.SQL,
    "op13_collocations": collocations.SQL,
}
