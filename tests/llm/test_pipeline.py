"""The pipeline, stage by stage, against plain versions on one machine."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from rastrel.llm import decontaminate, line_dedup, ngram_join, quality

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


def lines_brute(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= line_dedup.MIN_CHARS:
                held[key(x)].add(i)
    gone = {k for k, v in held.items() if len(v) >= line_dedup.MIN_DOCS}
    return {i: "\n".join(x for x in t.split("\n") if key(x) not in gone or max(held[key(x)]) == i) for i, t in docs.items()}


def near_brute(docs):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    ids, sets = sorted(docs), {i: shingles(t) for i, t in docs.items()}
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= ngram_join.PERCENT * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if root(i) == i}


def test_pipeline_matches_plain_versions(spark):
    import sentencepiece

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(spark, table, spark.read.parquet(f"{SF}/labels.parquet"))
    raw = {r.doc_id: r.text for r in table.collect()}
    ids = sorted(raw)
    scores = dict(zip(ids, model.score(quality.features([(raw[i] or "").encode() for i in ids])), strict=True))
    want = {i: raw[i] for i in ids if scores[i] >= quality.THRESHOLD}
    assert 0 < len(want) < len(ids)
    want = near_brute(lines_brute(want))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: t for i, t in want.items() if not any(x.lower() in t.lower() for x in items if len(x) >= decontaminate.MIN_CHARS)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert all(list(got[i].ids) == sp.encode(t) and got[i].round_trip and got[i].n_pieces == len(got[i].ids) for i, t in want.items())


def test_stages_keep_the_columns_and_take_any_rows(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert out.count() <= docs.count()
        assert stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_one_row_of_each_class_stays(spark):
    """Rows without an id, or with a repeated one, are rows of their own."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(None, base), (None, base), (None, base + " x"), (5, base + " y"), (5, base + " y"), (7, "quite another text of its own words"), (7, "and a second one with the same id here"), (8, None), (8, None), (9, ""), (None, "a text that only rows without an id have"), (None, "a text that only rows without an id have")]
    df = spark.createDataFrame([(i, t, "en", f"s{n}", 1) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()), key=str)
    assert got == sorted([rows[3], rows[5], rows[6], rows[7], rows[8], rows[9], rows[10]], key=str)


def test_intermediates_are_deleted(spark):
    from rastrel import shared

    before = set(shared._made)
    out = corpus_pipeline.run(spark, SF)
    left = [p for p in shared._made if p not in before]
    assert len(left) == 1 and out.count() > 0
