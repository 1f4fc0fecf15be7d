"""Language models are counted from all training rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.llm import language


def test_languages_are_counted_from_all_training_rows(spark):
    ids = spark.range(12_000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("of")).where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1").orderBy("doc_id").collect()
    word = lambda i, letters: "".join(letters[i * 7 // 3**k % len(letters)] for k in range(12))
    zero, others = [r for r in ids if r.of == 0], [r for r in ids if r.of > 0]
    rows = [(r.doc_id, "zz", word(r.doc_id, "xyzq")) for r in zero[:5]]  # all in one part
    rows += [(r.doc_id, "yy", word(r.doc_id, "uvw")) for r in others[:40]]  # none in the first part
    rows += [(r.doc_id, "en", word(r.doc_id, "abcde") + " " + word(r.doc_id + 5, "abcdx")) for r in zero[5:] + others[40:]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.train(spark, docs)
    assert model.langs == ["en", "yy", "zz"] and set(model.limit) == {"en", "yy"}
    for x, m in zip(model.langs, model.models, strict=True):
        keys, n = np.unique(language.grams([t for _, own, t in rows if own == x])[0], return_counts=True)
        assert (m.levels[0][2] == keys).all() and (m.levels[0][3] == n).all()
    first = {r.doc_id for r in zero}
    part = [language.KneserNey(*np.unique(language.grams([t for i, own, t in rows if own == "en" and i not in first])[0], return_counts=True), model.models[0].alphabet)]
    h, _ = language.Identifier(["en"], part).entropies([t for i, own, t in rows if own == "en" and i in first])
    assert model.limit["en"] == pytest.approx(np.quantile(h[:, 0], language.QUANTILE) * language.MARGIN)
    got = {r.doc_id: r.lang_pred for r in language.identify(spark, docs, model).collect()}
    assert all(got[i] == x for i, x, _ in rows if x == "zz")
