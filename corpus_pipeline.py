"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination and packing, in this order."""

from __future__ import annotations

from tarnwick.llm import decontaminate, lines, nearcopies, packing, toxicity
from tarnwick.llm.common import table, written

#: (name, function of (spark, docs, sf_dir)); each works on all that the one before it kept.
STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", lines.stage),
    ("near-dedup", nearcopies.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: The stages train a model, follow links and align texts, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages applied to the documents; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
