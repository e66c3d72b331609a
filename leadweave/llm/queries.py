"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from leadweave.llm import bagminhash, hardneg, langid, layout, mixing, periodic, positional, projections, quality, quotes, secrets, toxicity, warc
from leadweave.shipping import shipped

QUERIES = {
    "op1_bagminhash": shipped(bagminhash.op1_bagminhash),
    "op10_projections": shipped(projections.op10_projections),
    "op11_quality": shipped(quality.op11_quality),
    "op12_runs": shipped(periodic.op12_runs),
    "op13_hardneg": shipped(hardneg.op13_hardneg),
    "op2_secrets": shipped(secrets.op2_secrets),
    "op3_warc": shipped(warc.op3_warc),
    "op4_toxicity": shipped(toxicity.op4_toxicity),
    "op5_quotes": shipped(quotes.op5_quotes),
    "op6_layout": shipped(layout.op6_layout),
    "op7_decontaminate": shipped(positional.op7_decontaminate),
    "op8_langid": shipped(langid.op8_langid),
    "op9_mix": shipped(mixing.op9_mix),
}
ORACLE_SQL = {
    "op13_hardneg": hardneg.ORACLE_SQL,
    "op2_secrets": secrets.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op7_decontaminate": positional.ORACLE_SQL,
    "op9_mix": mixing.ORACLE_SQL,
}
