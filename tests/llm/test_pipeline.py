"""The registered queries on the smallest tables, and the pipeline stage by stage against plain Python."""

import duckdb
import pytest
from oracle import compare
from test_ngram_join import expected as near_duplicates
from test_shingles import plain
from test_spans import plain_pii

import __spark_entry__ as contract
import corpus_pipeline
from plumeline.llm import queries, tokens

SEVEN = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return c


def test_all_are_registered():
    names = set(contract.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, folder, name):
    assert compare(queries.QUERIES[name](spark, folder), con, queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_covers_its_table(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    if name in ("op10_main_text",):
        assert got.count() == spark.read.parquet(f"{folder}/pages.parquet").count()
    elif name == "op7_nearest_neighbours":
        asked = spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 50 = 0").count()
        assert got.count() == 5 * asked
    elif name == "op11_whitening":
        assert got.count() == 4 * spark.read.parquet(f"{folder}/embeddings.parquet").count()
    elif name == "op8_paragraph_dedup":
        assert got.where("not removed").count() < got.count()
    else:
        assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{folder}/documents.parquet").count()


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What every stage got and gave."""
    out, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    base = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{base}/{name}")
        made = spark.read.parquet(f"{base}/{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_columns(stages):
    for name, (_, made) in stages.items():
        if name != "packing":
            assert made.columns == SEVEN, name


def test_toxic_documents_go(spark, stages, folder):
    docs, made = stages["toxicity"]
    left = {r.doc_id for r in made.select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in left for d in clean) >= 0.95 * len(clean)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(made_text == texts[d] for d, made_text in ((r.doc_id, r.text) for r in made.collect()))


def test_one_of_each_group_stays(stages):
    docs, made = stages["ngram_join"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    worded = [r for r in rows if plain(r[1])]
    kept = {g for _, _, g in near_duplicates(worded)} | {str(d) for d, t in rows if not plain(t)}
    assert {str(r.doc_id) for r in made.collect()} == kept


def test_personal_data_is_replaced(stages):
    docs, made = stages["pii"]
    before = {r.doc_id: r.text for r in docs.collect()}
    assert made.count() == docs.count()
    for r in made.collect():
        spans = plain_pii(before[r.doc_id])
        assert all(before[r.doc_id][a:b] not in r.text for _, a, b in spans)
        assert r.n_chars == len(r.text)
        if not spans:
            assert r.text == before[r.doc_id]


def test_mix_takes_what_it_says(stages):
    docs, made = stages["mixing"]
    size = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    taken, source = {}, {}
    for r in made.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
        source[r.doc_id] = r.source
    assert all(taken[d] <= 2 * size[d] for d in taken)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.001)


def test_pieces_hold_every_token(stages):
    docs, made = stages["packing"]
    encoder = tokens.Words(queries.tokenizer_path())
    want = sum(len(encoder.ids(r.text)) // 4 + 1 for r in docs.collect())
    assert sum(r.length for r in made.collect()) == want


def test_run_gives_the_last_stage(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == stages["packing"][1].columns
    assert got.count() > 0
