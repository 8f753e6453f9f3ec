"""The corpus pipeline, stage by stage against brute force, and its whole run."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import decontamination
from ledgerloom.llm.tables import table
from tests.llm.conftest import SCHEMA
from tests.llm.test_pairs import brute_classes, brute_substrings

DATA = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def test_stages_and_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark):
    docs = table(spark, DATA, "documents")
    kept = STAGE["toxicity"](spark, docs, DATA)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    labels = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    stays = {r.doc_id for r in kept.collect()}
    toxic, clean = [d for d, t in labels.items() if t], [d for d, t in labels.items() if not t]
    assert np.mean([d in stays for d in clean]) >= 0.98 and np.mean([d in stays for d in toxic]) <= 0.5
    whole = {r.doc_id: r.asDict() for r in docs.collect()}
    assert all(whole[r.doc_id] == r.asDict() for r in kept.collect())


def test_pair_stages(spark, prose):
    texts = [prose(60) for _ in range(4)]
    texts += [texts[0], texts[1] + " more", f"{prose(20)} {texts[2]} {prose(30)}", None, ""]
    rows = [(i + 10, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, texts[0], None, None, 1), (10, texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    once = STAGE["ngram_jaccard_join"](spark, docs, DATA)
    expected = sorted(i + 10 for i, (label, _) in brute_classes(texts).items() if label == i)
    assert sorted(r.doc_id for r in once.collect() if r.doc_id is not None) == expected and once.where("doc_id is null").isEmpty()
    kept = {r.doc_id: r for r in STAGE["substring_dedup"](spark, once.where("doc_id is not null"), DATA).collect()}
    for i, n_words, n_removed, text in brute_substrings([(i, texts[i - 10]) for i in expected], 50):
        assert (i in kept) == (n_removed == 0 or n_removed < n_words)
        if i in kept:
            assert " ".join(kept[i].text.split()) == text and (n_removed == 0 or kept[i].n_chars == len(kept[i].text))


def test_contaminated_documents_go(spark, prose):
    item = table(spark, DATA, "benchmark").first()
    texts = [prose(40), f"{prose(9)} {item.text} {prose(9)}", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert decontamination.ERROR_RATE < 0.2
    assert sorted(r.doc_id for r in STAGE["benchmark_decontamination"](spark, docs, DATA).collect()) == [0, 2]


def test_null_and_shared_ids(spark, prose):
    """Each row is judged by its own text: shared ids lose no clean text, null ids hide no benchmark item."""
    item = table(spark, DATA, "benchmark").first()
    clean, other, dirty = prose(60), prose(60), f"{prose(9)} {item.text} {prose(9)}"
    rows = [(1, clean), (1, other), (2, clean), (2, dirty), (None, dirty), (None, other)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    named = docs.where("doc_id is not null")
    assert sorted((r.doc_id, r.text) for r in STAGE["ngram_jaccard_join"](spark, named, DATA).collect()) == sorted([(1, clean), (1, other), (2, dirty)])
    # rows without an id are deduplicated too; an id wins, and a null counts in what tells rows apart
    assert sorted((r.doc_id or 0, r.text) for r in STAGE["ngram_jaccard_join"](spark, docs.unionByName(docs.where("doc_id is null")), DATA).collect()) == sorted([(1, clean), (1, other), (2, dirty)])
    shifted = spark.createDataFrame([(5, clean, None, "s", 1), (5, None, clean, "s", 1)], SCHEMA)
    assert STAGE["ngram_jaccard_join"](spark, shifted, DATA).count() == 2
    alone = docs.where("doc_id is null")
    assert STAGE["ngram_jaccard_join"](spark, alone.unionByName(alone), DATA).count() == 2
    stays = {(r.doc_id, r.text) for r in STAGE["benchmark_decontamination"](spark, docs, DATA).collect()}
    assert stays == {(1, clean), (1, other), (2, clean), (None, other)}


@pytest.fixture(scope="module")
def packed(spark):
    return corpus_pipeline.run(spark, DATA).persist()


def test_run_equals_its_stages(spark, packed):
    docs = table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    found = {r.doc_id: (r.n, r.t) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()}
    assert found == {i: (n, n) for i, n in tokens.items()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
