"""The queries opN_ and their SQL."""

from __future__ import annotations

from ..sources.session import table
from . import ann, bins, bpe, centroids, classifier, dialogue_repair, jaccard_join, packing, para_dedup, quality_rules, sharding, token_counts, wavelet


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_token_files(spark, sf_dir):
    return wavelet.token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_bpe(spark, sf_dir):
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_classifier(spark, sf_dir):
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark, sf_dir):
    return para_dedup.report(table(spark, sf_dir, "documents"))


def op10_nearest(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_centroid_clustering(spark, sf_dir):
    return centroids.inertia(centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_dialogue_repair(spark, sf_dir):
    return dialogue_repair.audits(dialogue_repair.damage(table(spark, sf_dir, "conversations")), "present")


def op13_best_fit_packing(spark, sf_dir):
    return bins.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_token_counts, op3_token_files, op4_quality_rules, op5_sharding, op6_bpe, op7_jaccard_join, op8_classifier,
        op9_substring_dedup, op10_nearest, op11_centroid_clustering, op12_dialogue_repair, op13_best_fit_packing,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.ORACLE,
    "op11_centroid_clustering": centroids.oracle(),
    "op12_dialogue_repair": dialogue_repair.ORACLE,
}
