"""Null ids, repeated rows, empty tables and columns with clashing names, operator by operator."""

import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, decontaminate, lm, mixing, near, repeats, token_counts, toxicity

COLUMNS = ["size", "source_size", "target", "copies", "copy", "h", "root", "score", "spans", "fp", "levels", "part", "key", "n_bytes", "m", "tok", "a", "b"]
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ROWS = [(1, LONG, "s"), (2, LONG + " end", "s"), (2, LONG + " end", "s"), (None, LONG, None), (None, "quite other words stand here now", "t"), (5, None, "t"), (6, "", None), (7, "a", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in COLUMNS]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, LONG), (2, None), (3, ""), (None, "quite other words"), (3, LONG)], "item_id long, text string").withColumn("doc_id", F.lit(9))


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and got[0].h == "x"
    assert {r.source: r.source_size for r in got} == {"s": 15 + 2 * 16 + 1, "t": 6, None: 15}
    assert mixing.mix(empty).collect() == [] and mixing.mixed_rows(empty).collect() == []
    assert all(1 <= r.copy <= r.copies for r in mixing.mixed_rows(docs).collect())


def test_near(docs, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near.near_components(docs, 4, 85, 100).collect()), key=str)
    # Among members without an id, the smallest that there is.
    assert got == sorted([(1, 12, 1), (2, 13, 1), (2, 13, 1), (None, 12, 1), (None, 3, None), (5, 0, 5), (6, 0, 6), (7, 1, 7)], key=str)
    assert near.one_of_each(docs).columns == docs.columns and near.one_of_each(docs).count() == 5
    assert near.near_components(empty).collect() == [] and near.one_of_each(empty).collect() == []


def test_leaks(docs, empty, items):
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.aligned(docs, items).collect()), key=str)
    assert got == sorted([(i, j) for i in (1, 2, 2, None) for j in (1, 3)] + [(None, None)], key=str)
    left = decontaminate.without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == ["", "", "a"]
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == len(ROWS) and decontaminate.without_leaks(empty, items).collect() == []
    assert decontaminate.aligned(docs, items.limit(0)).collect() == []


def test_chats(spark):
    rows = spark.createDataFrame([(None, 0, "user", "q"), (None, None, None, None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a")], "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("x"))
    got = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    assert len(got) == 2 and got[1].formatted.count("<|im_start|>assistant\na<|im_end|>") == 2 and not got[1].valid
    assert [s.text for s in got[1].segments if s.loss] == ["a", "a"] and got[None].formatted.startswith("<|im_start|>\n<|im_end|>")
    assert chat.format_chats(rows.limit(0)).collect() == []


def test_scores(docs, empty):
    got = lm.score(docs, docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert lm.score(empty, docs).collect() == [] and lm.score(empty, empty).collect() == []


def test_repeats(docs, empty):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.without_repeats(docs, 60, 20).collect()), key=str)
    n = len(LONG)
    assert got == sorted([(1, n, n), (2, n + 4, n + 4), (2, n + 4, n + 4), (None, n, n), (None, 32, 0), (5, 0, 0), (6, 0, 0), (7, 1, 0)], key=str)
    assert repeats.without_repeats(empty).collect() == []


def test_token_counts(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = sorted(((i, len(own.encode(t or "", add_special_tokens=False))) for i, t, _ in ROWS), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()), key=str) == want
    assert token_counts.count_tokens(empty, path).collect() == []


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None), (7, 3)], "doc_id long, toxic int").withColumn("text", F.lit("y"))
    model = toxicity.train(docs, labels)
    assert toxicity.add_scores(docs, model).count() == len(ROWS) and toxicity.add_scores(empty, model).collect() == []
    assert {r.score for r in toxicity.add_scores(docs, toxicity.train(empty, labels)).collect()} == {0.0}
