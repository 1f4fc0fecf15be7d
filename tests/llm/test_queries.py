"""Every query of the subpackage on the fixture tables: through its SQL where there is one, else against a plain version of what it must return."""

import os
import zlib

import numpy as np
import pytest

from rastrel.llm import queries

duckdb = pytest.importorskip("duckdb")
P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for x in os.listdir(SF):
        p = f"{SF}/{x}"
        c.execute(f"CREATE VIEW {x.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.fixture(scope="module")
def texts(sql):
    return dict(sql.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


def run(spark, name):
    return queries.QUERIES[name](spark, SF)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_its_sql_gives(spark, sql, name):
    df = run(spark, name)
    cols = sorted(df.columns)
    cur = sql.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    df = run(spark, "op1_token_files")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint"] * 4
    assert sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op3(spark, sql, texts):
    """Whole items word for word are found in every text that holds them."""
    items = sql.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r.doc_id, r.item_id): r for r in run(spark, "op3_benchmark_decontamination").collect()}
    whole = {(i, j) for i, t in texts.items() for j, x in items if x and x.lower() in t.lower()}
    assert whole and whole <= set(got) and all(got[k].edits == 0 for k in whole)
    assert all(texts[i][r.begin : r.end].lower() == dict(items)[j].lower() for (i, j), r in got.items() if r.edits == 0)


def test_op6(spark, texts):
    rows = {r.doc_id: r for r in run(spark, "op6_quality_classifier").collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op7(spark, sql, texts):
    rows = {r.doc_id: r for r in run(spark, "op7_language_id").collect()}
    langs = {x for (x,) in sql.execute("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL").fetchall()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i])) and r.lang_pred in langs | {"und"}


def test_op9(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(i, len(ids := sp.encode(t)), crc(ids)) for i, t in texts.items()]
    rows = run(spark, "op9_sentencepiece").collect()
    assert sorted((r.doc_id, r.n_pieces, r.ids_crc32) for r in rows) == want and all(r.round_trip for r in rows)


def test_every_query_has_a_check():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert {n.split("_")[0] for n in queries.SQL} >= {"op2", "op4", "op5", "op8", "op10"}
