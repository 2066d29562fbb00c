"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from talkloom.llm import audio, decontaminate, lbl, linededup, mixing, pagetext, quality, secrets, simhash, suffixdedup, toxicity, vectorcodes, whitening
from talkloom.sources.scratch import table


def _on(name, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_audio_fingerprints": _on("conversations", audio.op1_turns),
        "op2_secret_scan": _on("documents", secrets.op2),
        "op3_benchmark_decontamination": lambda spark, d: decontaminate.op3(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op4_page_text": _on("pages", pagetext.op4),
        "op5_lbl_scores": _on("documents", lbl.op5),
        "op6_simhash_near_dedup": _on("documents", simhash.op6),
        "op7_toxicity_fm": lambda spark, d: toxicity.op7(table(spark, d, "documents"), table(spark, d, "labels")),
        "op8_quality_mil": lambda spark, d: quality.op8(table(spark, d, "documents"), table(spark, d, "labels")),
        "op9_mixing_poisson": _on("documents", mixing.op9),
        "op10_line_dedup": _on("documents", linededup.op10),
        "op11_vector_codes": _on("embeddings", vectorcodes.op11),
        "op12_whitening": _on("embeddings", whitening.op12),
        "op13_suffix_dedup": _on("documents", suffixdedup.op13),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing_poisson": mixing.OP9_SQL, "op10_line_dedup": linededup.OP10_SQL, "op11_vector_codes": vectorcodes.OP11_SQL}
