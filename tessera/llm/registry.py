"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import jaccard, lines, neardup, negatives, quality, urls
from .store import shared_dir, table


def op1_lm_scores(spark, sf_dir):
    from .lm import op1_lm_scores as op

    return op(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    import public_tokenizers as P

    from .packing import op2_best_fit_packing as op

    return op(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, shared_dir(spark))


def op3_token_counts(spark, sf_dir):
    import public_tokenizers as P

    from .rollup import op3_token_counts as op

    versions = {"byte-bpe": P.path("byte_bpe_50k.tiktoken"), "byte-bpe-multi": P.path("byte_bpe_multi_50k.tiktoken")}
    return op(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), shared_dir(spark), versions, P.PATTERN)


def op4_quality_rules(spark, sf_dir):
    from .quality import op4_quality_rules as op

    return op(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark, sf_dir):
    return jaccard.op5_ngram_jaccard(table(spark, sf_dir, "documents"))


def op6_url_filters(spark, sf_dir):
    return urls.op6_url_filters(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers as P

    from .bpe import op7_byte_bpe as op

    return op(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op8_nearest(spark, sf_dir):
    from .ann import op8_nearest as op

    return op(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark, sf_dir):
    return lines.op9_line_dedup(table(spark, sf_dir, "documents"))


def op10_token_files(spark, sf_dir):
    import public_tokenizers as P

    from .tokenfile import op10_token_files as op

    return op(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), shared_dir(spark))


def op11_hard_negatives(spark, sf_dir):
    return negatives.op11_hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark, sf_dir):
    from .runs import op12_periodic_runs as op

    return op(table(spark, sf_dir, "documents"))


def op13_near_duplicates(spark, sf_dir):
    return neardup.op13_near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scores, op2_best_fit_packing, op3_token_counts, op4_quality_rules, op5_ngram_jaccard, op6_url_filters, op7_byte_bpe, op8_nearest, op9_line_dedup, op10_token_files, op11_hard_negatives, op12_periodic_runs, op13_near_duplicates)
}
SQL = {"op4_quality_rules": quality.SQL, "op5_ngram_jaccard": jaccard.SQL, "op6_url_filters": urls.SQL, "op9_line_dedup": lines.SQL, "op11_hard_negatives": negatives.SQL, "op13_near_duplicates": neardup.SQL}
