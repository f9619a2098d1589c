"""All ten queries and the pipeline over one odd table and over an empty one: nulls in any column, empty and
very long texts, repeated rows and ids, ties, and columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from tidewater.llm import pipeline, registry

CLASHES = "score double, rejected boolean, lang_pred string, n_entities int, Key string, _key long, odd string, digest string, place int, row int, class_id int, _n int, text_ string, `a.b c` string"
TEXTS = [None, "", " ", "½ ²", "x" * 40_000, "lorem ipsum dolor sit amet " * 120_000, "short one", "same text of several words here", "same text of several words here", "mail a@b.example.com or Dr. Anna Vogt", "日本語 текст <|endoftext|>", "the words of an item that leaks here"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    extra = (0.5, True, "xx", 3, "k", 7, "o", "d", 1, 2, 3, 4, "t", "dots")
    rows = [(None if i in (2, 8) else i if i != 6 else 5, t, None if i == 4 else "en", None if i == 1 else "s", None if i == 3 else len(t or ""), *(extra if i % 2 else [None] * len(extra))) for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[0], rows[9]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
    for name, these in (("full", rows), ("none", [])):
        spark.createDataFrame(these, schema).write.parquet(f"{at}/{name}/documents.parquet")
        spark.createDataFrame([(1, "words of an item that leaks"), (None, "short one"), (1, None), (2, "")] if these else [], "item_id long, text string").write.parquet(f"{at}/{name}/benchmark.parquet")
        spark.createDataFrame([(1, 1, 1), (1, 0, 0), (5, 1, 0), (None, 1, 1), (7, None, None)] if these else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/{name}/labels.parquet")
        spark.createDataFrame([(1, 1, "user", "hi", 9), (1, 1, "assistant", None, 9), (1, 1, "assistant", None, 9), (None, None, None, "x" * 3_000_000, 9), (None, 1, "assistant", "y", 9), (2, None, "assistant", "", 9), (2, 1 << 62, "assistant", "</turn>", None)] if these else [], "conv_id long, turn long, role string, text string, message int").write.parquet(f"{at}/{name}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(spark, tables, name):
    n = registry.QUERIES[name](spark, f"{tables}/none").count()
    assert n == (name.startswith("op2_"))  # the contract's own conversation


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd(spark, tables, name):
    rows = registry.QUERIES[name](spark, f"{tables}/full").collect()
    n = len(TEXTS) + 3
    if name.startswith("op2_"):
        assert sorted(((r.conv_id, r.n_turns, r.loss_chars) for r in rows), key=str) == sorted([(1, 3, 0), (None, 1, 0), (None, 1, 1), (2, 2, 7), (-7, 2, 26)], key=str)
    elif name.startswith("op5_"):
        assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == [(11, 1), (5, None)]
    elif name.startswith("op10_"):
        assert len(rows) == len({r.doc_id for r in rows}) + 1  # the rows without an id, and a row an id
    elif name.startswith("op7_"):
        assert len({(r.doc_id, r.doc_tokens) for r in rows}) > 8 and sum(r.start == 0 for r in rows) == n and max(r.length for r in rows) <= 2048
    elif name == "pipeline":
        assert {r.doc_id for r in rows if r.start == 0} <= {None, 4, 5, 7, 9, 10} and 9 in {r.doc_id for r in rows}
    else:
        assert len(rows) == n


def test_stages_keep_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    before = {(r.doc_id, tuple(r[5:])) for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tables}/full")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = docs.collect()
        assert rows and all((r.doc_id, tuple(r[5:])) in before for r in rows), name


def test_stages_called_on_their_own(spark, tables):
    """What language would have rejected: null texts are no copies, empty ones are."""
    docs = spark.read.parquet(f"{tables}/full/documents.parquet").filter("text is null or text = ''")
    docs = docs.unionAll(docs)
    for name, stage in pipeline.STAGES[1:]:
        out = stage(spark, docs, f"{tables}/full")
        empty = out.filter("length = 1") if name == "packing" else out
        assert empty.count() == (5 if name == "near_duplicates" else 6), name
    assert pipeline.near_duplicates(spark, docs, f"{tables}/full").filter(F.col("text") == "").count() == 1
