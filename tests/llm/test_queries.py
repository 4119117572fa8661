"""The registered queries: SQL for those that have it, and the pipeline stage by stage."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from bootloom.llm.queries import ORACLES, QUERIES
from checks.compare import rows_of
from tests.llm import plain
from tests.llm.test_near_copies import brute as near
from tests.llm.test_spans import brute as cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    ran = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(ran.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(ran.columns, ran.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_each(spark, name):
    table = "pages" if name == "op7_urls" else "documents"
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_stages(spark):
    """Each stage on what the one before kept, against plain loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    toxic = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SF).collect() if r.predicted}
    want = {"toxicity": sorted(r for r in kept if r[0] not in toxic)}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = sorted((r.doc_id, r.text) for r in after.collect())
        if name == "near_duplicates":
            want[name] = sorted(r for r in kept if r[0] in {least for _, least in near(kept)})
        elif name == "substrings":
            want[name] = sorted((i, t) for (i, _), (t, _, _) in zip(kept, cut(kept)))
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want[name] = sorted((i, t) for (i, t), row in zip(kept, contaminated_rows(kept, items)) if not row)
        elif name == "bpe":
            want[name] = kept
        assert rows == want[name], name
        assert after.columns[: len(columns)] == columns and (name == "bpe" or after.columns == columns)
        docs = spark.createDataFrame(after.collect(), after.schema)
        kept = rows


def contaminated_rows(docs, items, window=10):
    """Whether each document has a window of any item."""
    windows = {}
    for _, text in items:
        words = plain.plain_words(text)
        m = min(window, len(words))
        windows.setdefault(m, set()).update(tuple(words[k : k + m]) for k in range(len(words) - m + 1 if m else 0))
    for _, text in docs:
        words = plain.plain_words(text)
        yield any(tuple(words[s : s + m]) in own for m, own in windows.items() for s in range(len(words) - m + 1))


def test_pipeline_runs_through(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"] and 0 < got.count() < 200


CLASHES = ["score", "predicted", "n_sentences", "n_removed", "n_words", "n_hit", "n_items", "item_ids", "contaminated"]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Odd rows whose columns have the names of all that the operators add, each with a value of its own."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", None, 7, *[f"{c} of {k}" for c in CLASHES], f"tokens of {k}") for k, (i, t) in enumerate(plain.ODD)]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"{c} string" for c in CLASHES]]
    spark.createDataFrame(rows, ", ".join([*names, "n_tokens string"])).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "zo")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_the_columns_of_odd_rows(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    columns = docs.columns
    own = {tuple(r[c] for c in CLASHES): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, odd_tables)
        rows = after.collect()
        assert rows and len({tuple(r[c] for c in CLASHES) for r in rows}) == len(rows)
        for r in rows:
            before = own[tuple(r[c] for c in CLASHES)]
            assert r.doc_id == before.doc_id and r.lang == "en" and r.source is None
            assert name == "bpe" or r.n_tokens == before.n_tokens
            assert r.n_chars == (7 if r.text == before.text else len(r.text))
        if name == "bpe":
            assert after.columns == [c for c in columns if c != "n_tokens"] + ["n_tokens", "ids_sha256", "decoded_sha256"]
            assert {type(r.n_tokens) for r in rows} == {int}
        else:
            assert after.columns == columns
        docs = spark.createDataFrame(rows, after.schema)
    assert docs.where("doc_id = 9").count() == 1


def test_pipeline_on_odd_and_empty_tables(spark, odd_tables, tmp_path):
    assert 0 < corpus_pipeline.run(spark, odd_tables).count() < len(plain.ODD)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.collect() == [] and got.columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"]
    plain_docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        plain_docs = stage(spark, plain_docs, odd_tables)
    assert sorted(r.doc_id for r in plain_docs.collect()) == [1, 2]
