"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, line_dedup, ngram_join, pieces, quality, sharding, suffix_dedup, token_files, top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_files.write(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, files)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(spark, _table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that meet."""
    return decontaminate.find(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(spark, _table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(spark, _table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(spark, docs, _table(spark, sf_dir, "labels"))
    got = quality.score(spark, docs, model)
    return got.select("doc_id", F.coalesce(quality.fold(quality.FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    got = language.identify(spark, docs, language.train(spark, docs))
    return got.select("doc_id", F.coalesce(quality.fold(language.FOLDS) == language.HELD, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(spark, _table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (as op1 has it) and round_trip: whether the ids decode to the text."""
    import public_tokenizers

    return pieces.digest(pieces.encode_documents(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(spark, _table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_line_dedup, op3_benchmark_decontamination, op4_rendezvous_sharding, op5_suffix_array_dedup, op6_quality_classifier, op7_language_id, op8_ngram_jaccard_join, op9_sentencepiece, op10_exact_top_k)}

_WRAP = 1 << 64
_P = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]  # fixed values: the primes of XXH64


class _Xxh64:
    """XXH64 as columns that build on one another, in 128-bit numbers without a sign; the SQL has no such function."""

    def __init__(self, name: str, seed: str):
        self.name, self.columns, self.at = name, [], seed

    def _put(self, expr: str) -> str:
        self.columns.append(f"({expr})::UHUGEINT AS {self.name}{len(self.columns)}")
        self.at = f"{self.name}{len(self.columns) - 1}"
        return self.at

    def _times(self, p: int) -> str:
        return self._put(f"({self.at} * {p}::UHUGEINT) % {_WRAP}")

    def _turn(self, r: int) -> str:
        return self._put(f"({self.at} * {1 << r}::UHUGEINT) % {_WRAP} + {self.at} // {1 << (64 - r)}")

    def _mixed(self, x: str) -> str:
        return self._put(f"xor({self.at}::UBIGINT, ({x})::UBIGINT)")

    def _end(self) -> _Xxh64:
        for p, n in ((_P[1], 33), (_P[2], 29), (None, 32)):
            self._mixed(f"{self.at} // {1 << n}")
            if p:
                self._times(p)
        return self

    def _four(self, x: str, size: int) -> None:
        self._put(f"({self.at} + {_P[4] + size}::UHUGEINT) % {_WRAP}")
        self._mixed(f"({x} * {_P[0]}::UHUGEINT) % {_WRAP}")
        self._turn(23)
        self._times(_P[1])
        self._put(f"({self.at} + {_P[2]}::UHUGEINT) % {_WRAP}")

    def long(self, x: str) -> _Xxh64:
        seed, self.at = self.at, f"(({x})::HUGEINT + {_WRAP}) % {_WRAP}"
        self._put(self.at)
        self._times(_P[1])
        self._turn(31)
        k = self._times(_P[0])
        self._put(f"({seed} + {_P[4] + 8}::UHUGEINT) % {_WRAP}")
        self._mixed(k)
        self._turn(27)
        self._times(_P[0])
        self._put(f"({self.at} + {_P[3]}::UHUGEINT) % {_WRAP}")
        return self._end()

    def over(self, source: str) -> str:
        """source with all columns, one subquery on another."""
        return reduce(lambda q, c: f"(SELECT *, {c} FROM {q})", self.columns, source)

    def int(self, x: str) -> _Xxh64:
        self._four(f"({x})::UHUGEINT", 4)
        return self._end()

    def word(self, x: str) -> _Xxh64:
        """A word of five bytes."""
        raw = x.encode()
        self._four(f"{int.from_bytes(raw[:4], 'little')}::UHUGEINT", 5)
        self._mixed(f"({raw[4]}::UHUGEINT * {_P[4]}::UHUGEINT) % {_WRAP}")
        self._turn(11)
        self._times(_P[0])
        return self._end()


_BID, _SALT = _Xxh64("x", "42::UHUGEINT").long("doc_id").int("s").word("shard"), _Xxh64("y", "42::UHUGEINT").long("doc_id").long("text_crc32")
_ROWS = sharding.SHARDS * sharding.ROWS

SQL = {
    "op4_rendezvous_sharding": f"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM generate_series(0, 255) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + {sharding.OVERHEAD})::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, tab
), n AS (SELECT greatest(1, (count(*) + {_ROWS - 1}) // {_ROWS}) AS n FROM d),
h AS (SELECT * FROM {_BID.over(f"(SELECT doc_id, s FROM (SELECT DISTINCT doc_id FROM d), generate_series(0, {sharding.SHARDS}) g(s))")}),
bid AS (SELECT doc_id, s, -ln((({_BID.at} // 2048)::DOUBLE + 0.5) / {1 << 53}::DOUBLE) AS b FROM h),
own AS (SELECT doc_id, arg_min(s, (b, s)) FILTER (s < {sharding.SHARDS}) AS shard, arg_min(s, (b, s)) AS grown_shard FROM bid GROUP BY doc_id),
y AS (SELECT * FROM {_SALT.over("d")}),
k AS (SELECT doc_id, size, text_crc32, ((({_SALT.at}::HUGEINT - CASE WHEN {_SALT.at} >= {1 << 63} THEN {_WRAP}::HUGEINT ELSE 0 END) % n) + n) % n AS bucket FROM y, n)
SELECT k.doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, k.doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard FROM k JOIN own USING (doc_id)
""",
    "op5_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM d, LATERAL (SELECT unnest(generate_series(0, n - 100)) AS p) WHERE n >= 100),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM hit),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM i),
span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, g),
cut AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM span UNION ALL SELECT doc_id, max(z), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN t IS NULL THEN substr(h, 2 * f + 1) ELSE substr(h, 2 * f + 1, 2 * (t - f)) END, '' ORDER BY f) AS k FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(z - a)::BIGINT AS gone, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op2_line_dedup": r"""
WITH line AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), often AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top IS NOT NULL AND doc_id <> top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (top IS NOT NULL AND doc_id <> top)), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (k) GROUP BY doc_id
""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
""",
}
