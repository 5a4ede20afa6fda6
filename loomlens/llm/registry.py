"""Queries of this subpackage: name to (function of spark and folder, DuckDB SQL or None)."""

from __future__ import annotations

from . import common as C
from . import audit, codes, copies, decontaminate, idfiles, licenses, lm, neardup, packing, quality, substrings, topk, toxicity


def op1_packing(spark, sf_dir):
    return packing.pack(C.table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op3_top_k_search(spark, sf_dir):
    return topk.search(C.table(spark, sf_dir, "embeddings"))


def op4_quality(spark, sf_dir):
    return quality.resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op5_id_files(spark, sf_dir):
    return idfiles.round_trip(C.table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return licenses.scan(C.table(spark, sf_dir, "documents")).drop("spans")


def op7_near_duplicates(spark, sf_dir):
    return neardup.classes(C.table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark, sf_dir):
    return substrings.removed(C.table(spark, sf_dir, "documents")).drop("spans")


def op9_language_model(spark, sf_dir):
    return lm.score(C.table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, C.table(spark, sf_dir, "labels")))


def op11_exact_copies(spark, sf_dir):
    return copies.groups(C.table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return codes.digest(C.table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark, sf_dir):
    return audit.audit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (op1_packing, None),
        (op2_decontamination, decontaminate.SQL),
        (op3_top_k_search, topk.SQL),
        (op4_quality, None),
        (op5_id_files, None),
        (op6_license_scan, None),
        (op7_near_duplicates, neardup.SQL),
        (op8_repeated_passages, None),
        (op9_language_model, None),
        (op10_toxicity, None),
        (op11_exact_copies, copies.SQL),
        (op12_vector_codes, codes.SQL),
        (op13_filter_audit, audit.SQL),
    )
}
