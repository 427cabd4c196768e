"""The corpus pipeline: its stages, each a call of one operator, and a run over the documents of a data folder.

Null and empty texts are scored as empty by the classifier; what it keeps of them the quality rules reject, as they have
fewer words than the least number. Rows without an id stay until packing, where their pieces have none. Repeated rows
are one group of copies, of which the near-duplicate stage leaves the rows of the least id, and substring dedup cuts
nothing between rows of one id and text. Other columns of documents pass through all stages but the last, whatever
their names. A table without rows gives no pieces; without labels every document has one score.
"""

from __future__ import annotations

from quaestor.llm import classifier, jaccard_join, packing, para_dedup, quality_rules
from quaestor.llm.queries import tokenizer
from quaestor.sources.session import Workspace, table


def _quality_classifier(spark, docs, sf_dir):
    """Keeps what the classifier predicts to be of quality."""
    return classifier.keep(docs, table(spark, sf_dir, "labels"))


def _quality_rules(spark, docs, sf_dir):
    """Keeps what the adaptive rules keep."""
    return quality_rules.filter_documents(docs)


def _near_duplicates(spark, docs, sf_dir):
    """Keeps one document, that of the least id, of each group linked by five-word shingles at 0.8 or more."""
    return jaccard_join.deduplicate(docs, words=5, percent=80)


def _substring_dedup(spark, docs, sf_dir):
    """Cuts repeated paragraphs and passages out of every document but one."""
    return para_dedup.clean(docs)


def _packing(spark, docs, sf_dir):
    """Packs what is left."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality classifier", _quality_classifier), ("quality rules", _quality_rules), ("near duplicates", _near_duplicates), ("substring dedup", _substring_dedup), ("packing", _packing)]

#: SQL can't express the stages; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; what each stage keeps is written and read again."""
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else work.write(out, f"stage{k}")
    return docs
