"""The SQL, for an independent engine, that checks the queries of ``queries``."""

from __future__ import annotations

from .functions import quant

_PLANE = """plane AS (
  SELECT vec_id, label, i - 1 AS pos, least(255, greatest(0, floor((embedding[i]::DOUBLE + 1) * 127.5)))::BIGINT AS px
  FROM embeddings, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i)
)"""

_BLOCKS = f"""{_PLANE}, d AS (
  SELECT vec_id, (pos // 32) * 2 + (pos % 8) // 4 AS block, pos // 8 % 4 AS i, pos % 4 AS j, px - 128 AS d FROM plane
)"""


def _four(source: str, keys: str, place: str, value: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"sum({value}) FILTER ({place} = {k})::BIGINT AS d{k}" for k in range(4)) + f" FROM {source} GROUP BY {keys}"


def _union(source: str, keys: str, place: str, value: str, exprs: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, {k} AS {place}, {e} AS {value} FROM {source}" for k, e in enumerate(exprs))


_FDCT = f"""{_BLOCKS}, r AS ({_four('d', 'vec_id, block, i', 'j', 'd')}), t AS (
  {_union('r', 'vec_id, block, i', 'j', 't', ['(d0 + d1 + d2 + d3) * 8', '((d1 - d2) * 2217 + (d0 - d3) * 5352 + 1812) >> 9', '(d0 + d3 - d1 - d2) * 8', '((d0 - d3) * 2217 - (d1 - d2) * 5352 + 937) >> 9'])}
), c AS ({_four('t', 'vec_id, block, j', 'i', 't')}), f AS (
  {_union('c', 'vec_id, block, j', 'i', 'c', ['(d0 + d1 + d2 + d3 + 7) >> 4', '(((d1 - d2) * 2217 + (d0 - d3) * 5352 + 12000) >> 16) + (d0 <> d3)::INT', '(d0 + d3 - d1 - d2 + 7) >> 4', '((d0 - d3) * 2217 - (d1 - d2) * 5352 + 51000) >> 16'])}
), fdct AS (SELECT vec_id, block::INT AS block, (i * 4 + j)::INT AS k, c::BIGINT AS c FROM f)"""

_WHT = ["d0 + d2 + d1 + d3", "d0 - d2 + d1 - d3", "d0 - d2 - d1 + d3", "d0 + d2 - d1 - d3"]
_Y1 = ", ".join(str(r[2:]) for r in quant.table(range(75, 76)) if r[1] == "y1")
_LEVELS = f"""{_FDCT}, dim(k, q, iq, bias, zero, sharpen) AS (VALUES {_Y1}), lv AS (
  SELECT vec_id, block, k, c, q, CASE WHEN abs(c) + sharpen > zero THEN sign(c) * least(((abs(c) + sharpen) * iq + bias) >> 17, 2047) ELSE 0 END::BIGINT AS level
  FROM fdct JOIN dim USING (k)
)"""

_INPUTS = """inputs AS (
  SELECT page_id, 'a/' || (page_id // 2 % 7)::VARCHAR || '/p' || (page_id // 2)::VARCHAR || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.PNG' END AS rel, strlen(html) AS size FROM pages
), outs AS (SELECT *, 'a/' || (page_id // 2 % 7)::VARCHAR || '/p' || (page_id // 2)::VARCHAR || '.webp' AS out_path FROM inputs),
existing AS (SELECT DISTINCT out_path FROM outs WHERE page_id % 5 = 0)"""

_SIZES = """sizes AS (
  SELECT 'img/' || p_brand || '/' || p_partkey::VARCHAR || '.png' AS rel, (p_size * 16 + p_partkey % 5 * 3)::INT AS w, (p_partkey % 40 * 16 + 16 + p_partkey % 3)::INT AS h FROM part
)"""

_NEIGHBOURS = f"""{_PLANE}, p AS (SELECT vec_id, list(px ORDER BY pos) AS px FROM plane GROUP BY vec_id),
n AS (
  SELECT p.vec_id, p.px, l.px IS NOT NULL AS hl, u.px IS NOT NULL AS hu,
    coalesce([l.px[8 * i] FOR i IN generate_series(1, 8)], [129 FOR i IN generate_series(1, 8)]) AS lc0,
    coalesce(u.px[57:64], [127 FOR i IN generate_series(1, 8)]) AS tr, l.px AS lpx
  FROM p LEFT JOIN p l ON l.vec_id = p.vec_id - 1 AND p.vec_id % 16 <> 0 LEFT JOIN p u ON u.vec_id = p.vec_id - 16
), e AS (SELECT * REPLACE (CASE WHEN hl THEN lc0 ELSE [129 FOR i IN generate_series(1, 8)] END AS lc0) FROM n),
g AS (
  SELECT *, CASE WHEN hl AND hu THEN (list_sum(tr) + list_sum(lc0) + 8)::BIGINT >> 4 WHEN hu THEN (list_sum(tr) + 4)::BIGINT >> 3 WHEN hl THEN (list_sum(lc0) + 4)::BIGINT >> 3 ELSE 128 END AS dc,
    CASE WHEN hu THEN 129 ELSE 127 END AS corner FROM e
), s AS (
  SELECT vec_id, unnest([0, 1, 2, 3]) AS mode, unnest([
    list_sum([(px[k + 1] - dc) ** 2 FOR k IN generate_series(0, 63)]),
    list_sum([(px[k + 1] - least(255, greatest(0, lc0[k // 8 + 1] + tr[k % 8 + 1] - corner))) ** 2 FOR k IN generate_series(0, 63)]),
    list_sum([(px[k + 1] - tr[k % 8 + 1]) ** 2 FOR k IN generate_series(0, 63)]),
    list_sum([(px[k + 1] - lc0[k // 8 + 1]) ** 2 FOR k IN generate_series(0, 63)])])::BIGINT AS sse FROM g
)"""

_OUTCOMES = """o AS (
  SELECT event_id, ts, user_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'fallback' WHEN 'view' THEN 'skipped' ELSE 'ok' END AS status,
    floor(value * 100)::BIGINT AS src_bytes, floor(value * 37)::BIGINT AS dst_bytes FROM events
)"""

_PICTURES = f"""{_PLANE}, pic AS (
  SELECT vec_id, (1 + vec_id % 8)::INT AS w, (1 + vec_id // 8 % 8)::INT AS h, [0, 2, 4, 6][vec_id % 4 + 1] AS color FROM embeddings
)"""

_PACKET = r"""t AS (SELECT conv_id, role AS key, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations WHERE text IS NOT NULL)"""



def _restored() -> list[str]:
    """The four values of one pass of the inverse transform, of d0 to d3."""
    big, small = (lambda x: f"(((d{x} * 20091) >> 16) + d{x})"), (lambda x: f"((d{x} * 35468) >> 16)")
    s, t, u, v = "(d0 + d2)", "(d0 - d2)", f"({small(1)} - {big(3)})", f"({big(1)} + {small(3)})"
    return [f"{s} + {v}", f"{t} + {u}", f"{t} - {u}", f"{s} - {v}"]


_BACK = ["(d0 + d3) + (d1 + d2)", "(d0 - d3) + (d1 - d2)", "(d0 + d3) - (d1 + d2)", "(d0 - d3) - (d1 - d2)"]


# The ten 4x4 modes (RFC 6386, section 12.3) cell by cell, as means of two or three pixels around a place of the edge:
# 0 to 3 the left column from the bottom up, 4 the corner, 5 to 12 the row above.
_DIRECTIONS = {
    2: "3:5 3:6 3:7 3:8 " * 4,
    4: "3:4 3:5 3:6 3:7 3:3 3:4 3:5 3:6 3:2 3:3 3:4 3:5 3:1 3:2 3:3 3:4",
    5: "2:4 2:5 2:6 2:7 3:4 3:5 3:6 3:7 3:3 2:4 2:5 2:6 3:2 3:4 3:5 3:6",
    6: "3:6 3:7 3:8 3:9 3:7 3:8 3:9 3:10 3:8 3:9 3:10 3:11 3:9 3:10 3:11 3:12",
    7: "2:5 2:6 2:7 2:8 3:6 3:7 3:8 3:9 2:6 2:7 2:8 3:10 3:7 3:8 3:9 3:11",
    8: "2:3 3:4 3:5 3:6 2:2 3:3 2:3 3:4 2:1 3:2 2:2 3:3 2:0 3:1 2:1 3:2",
    9: "2:2 3:2 2:1 3:1 2:1 3:1 2:0 1:1 2:0 1:1 1:0 1:0 1:0 1:0 1:0 1:0",
}


def _mean(cell: str) -> str:
    n, k = (int(x) for x in cell.split(":"))
    if n == 1:  # the lowest pixel on the left, alone or three times
        return "e[2]" if k == 0 else "((e[3] + 3 * e[2] + 2) >> 2)"
    return f"((e[{k + 2}] + e[{k + 3}] + 1) >> 1)" if n == 2 else f"((e[{k + 1}] + 2 * e[{k + 2}] + e[{k + 3}] + 2) >> 2)"


def _fours() -> list[str]:
    """The sixteen guesses of each mode as lists; e has a copy of its first and of its last pixel around it."""
    out = {m: "[" + ", ".join(map(_mean, cells.split())) + "]" for m, cells in _DIRECTIONS.items()}
    out[0] = "[(list_sum(e[7:10]) + list_sum(e[2:5]) + 4)::BIGINT >> 3 FOR k IN generate_series(0, 15)]"
    out[1] = "[least(255, greatest(0, e[5 - k // 4] + e[7 + k % 4] - e[6])) FOR k IN generate_series(0, 15)]"
    out[3] = "[" + ", ".join(x for x in (_mean("3:3"), _mean("3:2"), _mean("3:1"), _mean("1:1")) for _ in range(4)) + "]"
    return [out[m] for m in range(10)]


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


SQL = {
    "psnr_by_label": f"""WITH {_PLANE}, q AS (SELECT label, px, px - ((px + 8) >> 4) * 16 AS d FROM plane)
SELECT label, count(*) AS n, sum(px)::BIGINT AS sum_px, sum(d * d)::BIGINT AS sse, round(CASE WHEN sum(d * d) <= 0 THEN 99.0 ELSE 10 * log10(65025.0::DOUBLE * count(*) / sum(d * d)) END, 6) AS psnr FROM q GROUP BY label""",
    "plane_histogram": f"WITH {_PLANE} SELECT label, px, count(*) AS n FROM plane GROUP BY label, px",
    "run_lengths": f"""WITH {_PLANE}, v AS (SELECT vec_id, pos, px >> 3 AS v FROM plane),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY vec_id, v ORDER BY pos) AS g FROM v), r AS (SELECT vec_id, v, g, count(*) AS run FROM i GROUP BY ALL)
SELECT v, run, count(*) AS n FROM r GROUP BY v, run""",
    "fdct": f"WITH {_FDCT} SELECT * FROM fdct",
    "fwht": f"""WITH {_FDCT}, dc AS (SELECT vec_id // 4 AS mb, vec_id % 4 AS i, block AS j, c FROM fdct WHERE k = 0), a AS ({_four('dc', 'mb, i', 'j', 'c')}),
a0 AS (SELECT mb, i, coalesce(d0, 0) AS d0, coalesce(d1, 0) AS d1, coalesce(d2, 0) AS d2, coalesce(d3, 0) AS d3 FROM a), b AS ({_union('a0', 'mb, i', 'j', 't', _WHT)}),
b4 AS ({_four('b', 'mb, j', 'i', 't')}), b0 AS (SELECT mb, j, coalesce(d0, 0) AS d0, coalesce(d1, 0) AS d1, coalesce(d2, 0) AS d2, coalesce(d3, 0) AS d3 FROM b4),
z AS ({_union('b0', 'mb, j', 'i', 'c', [f'({x}) >> 1' for x in _WHT])}) SELECT mb, (i * 4 + j)::INT AS k, c FROM z""",
    "idct": f"""WITH {_LEVELS}, z AS (SELECT vec_id, block, k // 4 AS i, k % 4 AS j, level * q AS t FROM lv), p1 AS ({_four('z', 'vec_id, block, j', 'i', 't')}), p2 AS ({_union('p1', 'vec_id, block, j', 'i', 't', _restored())}),
p3 AS (SELECT vec_id, block, i, j, t + CASE WHEN j = 0 THEN 4 ELSE 0 END AS t FROM p2), p4 AS ({_four('p3', 'vec_id, block, i', 'j', 't')}), p5 AS ({_union('p4', 'vec_id, block, i', 'j', 'r', [f'({x}) >> 3' for x in _restored()])})
SELECT vec_id, block, (i * 4 + j)::INT AS k, r::BIGINT AS r FROM p5""",
    "pad_planes": f"""WITH {_PLANE}, s AS (SELECT DISTINCT vec_id, vec_id % 8 + 1 AS w, vec_id // 8 % 8 + 1 AS h FROM embeddings), g AS (SELECT vec_id, y, x, least(y, h - 1) * 8 + least(x, w - 1) AS pos FROM s, generate_series(0, 15) a(y), generate_series(0, 15) b(x))
SELECT vec_id, sum(px)::BIGINT AS total, sum(px * (16 * y + x + 1))::BIGINT AS weighted FROM g JOIN plane USING (vec_id, pos) GROUP BY vec_id""",
    "riff_chunks": """WITH p AS (SELECT page_id, encode(html) AS raw, hex(encode(html)) AS h, strlen(html) AS n, (1 + page_id % 5000)::INT AS w, (1 + page_id % 300)::INT AS hh FROM pages WHERE html IS NOT NULL),
le AS (SELECT *, unhex('1002009D012A' || format('{:02X}{:02X}{:02X}{:02X}', w % 256, w // 256, hh % 256, hh // 256) || h) AS frame, CASE WHEN page_id % 3 = 1 THEN 32 ELSE 0 END + CASE WHEN page_id % 2 = 1 THEN 8 ELSE 0 END AS flags FROM p),
c AS (SELECT page_id, 0 AS o, 'VP8X' AS type, unhex(format('{:02X}000000{:02X}{:02X}00{:02X}{:02X}00', flags, (w - 1) % 256, (w - 1) // 256, (hh - 1) % 256, (hh - 1) // 256)) AS x FROM le WHERE flags > 0
UNION ALL SELECT page_id, 1, 'ICCP', unhex(substr(h, 1, 14)) FROM le WHERE flags >= 32 UNION ALL SELECT page_id, 2, 'VP8 ', frame FROM le UNION ALL SELECT page_id, 3, 'EXIF', unhex(substr(h, 1, 20)) FROM le WHERE flags % 16 = 8)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY o) - 1)::INT AS seq, type, octet_length(x)::BIGINT AS size, md5(x) AS md5 FROM c""",
    "rgba_psnr": f"""WITH {_PICTURES}, d AS (SELECT vec_id, color, px % 16 AS e, CASE WHEN color >= 4 THEN (255 - px) % 16 ELSE 15 END AS f FROM pic JOIN plane USING (vec_id) WHERE pos % 8 < w AND pos // 8 < h),
m AS (SELECT vec_id, sum(3 * e * e + f * f)::DOUBLE / (4 * count(*)) AS mse FROM d GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN mse = 0 THEN 99.0::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / mse) END, 6) AS psnr FROM m""",
    "quarantine": "SELECT 'bad/' || page_id::VARCHAR || CASE page_id % 2 WHEN 0 THEN '.jpg' ELSE '.png' END AS rel, md5(html) AS md5 FROM pages WHERE html IS NOT NULL",
    "quantize_levels": f"WITH {_LEVELS} SELECT k, level, count(*) AS n, sum((c - level * q) * (c - level * q))::BIGINT AS sse FROM lv GROUP BY k, level",
    "zigzag_last": f"""WITH {_LEVELS}, m AS (SELECT vec_id, block, coalesce(max(list_position({quant.ZIGZAG}, k) - 1) FILTER (level <> 0), -1)::INT AS last FROM lv GROUP BY ALL)
SELECT last, count(*) AS blocks FROM m GROUP BY last""",
    "nz_context": f"""WITH {_LEVELS}, nz AS (SELECT vec_id, block, max((level <> 0)::INT) AS nz FROM lv GROUP BY ALL),
a AS (SELECT vec_id // 128 AS pic, (vec_id % 128 // 32) * 2 + block // 2 AS y, vec_id % 32 * 2 + block % 2 AS x, nz FROM nz),
j AS (SELECT a.nz, coalesce(l.nz, 0) + coalesce(u.nz, 0) AS ctx FROM a LEFT JOIN a l ON l.pic = a.pic AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN a u ON u.pic = a.pic AND u.x = a.x AND u.y = a.y - 1)
SELECT ctx, nz, count(*) AS n FROM j GROUP BY ctx, nz""",
    "y2_context": f"""WITH {_PLANE}, p AS (SELECT vec_id, vec_id // 32 AS row_, max(px) FILTER (pos = 0) % 3 = 0 AS small, (max(px) FILTER (pos = 1) % 2)::INT AS nz FROM plane GROUP BY vec_id)
SELECT a.vec_id, coalesce((SELECT b.nz FROM p b WHERE b.row_ = a.row_ AND b.vec_id < a.vec_id AND NOT b.small ORDER BY b.vec_id DESC LIMIT 1), 0) AS ctx FROM p a""",
    "predict_argmin": f"""WITH {_NEIGHBOURS}, c AS (SELECT vec_id, mode, sse * 256 + [302, 984, 439, 642][mode + 1] * 120 AS cost FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, mode) AS n FROM c) SELECT vec_id, mode::INT AS mode, cost FROM r WHERE n = 1""",
    "mode_top3": f"WITH {_NEIGHBOURS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sse, mode) - 1 AS n FROM s) SELECT vec_id, n::INT AS rank, mode::INT AS mode, sse FROM r WHERE n < 3",
    "predict_fours": f"""WITH {_PLANE}, p AS (SELECT vec_id, list(px ORDER BY pos) AS px FROM plane GROUP BY vec_id), b AS (SELECT vec_id, px, block, block // 2 * 4 AS y, block % 2 * 4 AS x FROM p, generate_series(0, 3) g(block)),
l AS (SELECT *, [CASE WHEN x = 0 THEN 129 ELSE px[8 * (y + 3 - k) + x] END FOR k IN generate_series(0, 3)] AS lf, CASE WHEN y = 0 THEN 127 WHEN x = 0 THEN 129 ELSE px[8 * (y - 1) + x] END AS corner,
  [CASE WHEN y = 0 THEN 127 ELSE px[8 * (y - 1) + least(x + k, 7) + 1] END FOR k IN generate_series(0, 7)] AS up FROM b),
e AS (SELECT vec_id, block, [px[8 * (y + k // 4) + x + k % 4 + 1] FOR k IN generate_series(0, 15)] AS own, list_concat([lf[1]], list_concat(lf, list_concat([corner], list_concat(up, [up[8]])))) AS e FROM l),
m AS (SELECT vec_id, block, own, unnest(generate_series(0, 9)) AS mode, unnest([{", ".join(_fours())}]) AS g FROM e)
SELECT vec_id, block::INT AS block, mode::INT AS mode, list_sum([(own[k] - g[k]) ** 2 FOR k IN generate_series(1, 16)])::BIGINT AS sse FROM m""",
    "rgb_to_y": """WITH y AS (SELECT least(255, greatest(0, (16839 * (l_partkey % 256) + 33059 * (l_suppkey % 256) + 6420 * l_quantity::BIGINT + 32768 + 1048576) >> 16))::BIGINT AS y FROM lineitem)
SELECT y, count(*) AS n FROM y GROUP BY y""",
    "rgb_to_uv": """WITH p AS (SELECT l_orderkey, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_quantity::BIGINT AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 256, l_suppkey % 256, l_quantity::BIGINT) - 1 AS n FROM lineitem),
c AS (SELECT l_orderkey, n // 4 AS cell, sum(r) + (4 - count(*)) * arg_max(r, n) AS r, sum(g) + (4 - count(*)) * arg_max(g, n) AS g, sum(b) + (4 - count(*)) * arg_max(b, n) AS b FROM p GROUP BY ALL),
s AS (SELECT l_orderkey, cell::INT AS cell, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b FROM c)
SELECT l_orderkey, cell, least(255, greatest(0, (-9719 * r - 19081 * g + 28800 * b + 131072 + 33554432) >> 18))::BIGINT AS u, least(255, greatest(0, (28800 * r - 24116 * g - 4684 * b + 131072 + 33554432) >> 18))::BIGINT AS v FROM s""",
    "quality_to_q": """WITH q AS (SELECT i AS quality, i / 100.0::DOUBLE AS c FROM generate_series(1, 100) t(i))
SELECT quality::INT AS quality, floor(127 * (1 - pow(CASE WHEN c < 0.75 THEN 2.0::DOUBLE * c / 3.0 ELSE 2.0::DOUBLE * c - 1.0 END, 1.0::DOUBLE / 3)))::INT AS q FROM q""",
    "quant_matrix": f"""WITH l AS (SELECT {quant.DC} AS dc, {quant.AC} AS ac, {quant.SHARPEN} AS sh), q AS (
  SELECT quality, floor(127 * (1 - pow(CASE WHEN quality < 75 THEN 2.0::DOUBLE * (quality / 100.0::DOUBLE) / 3 ELSE 2.0::DOUBLE * (quality / 100.0::DOUBLE) - 1 END, 1.0::DOUBLE / 3)))::INT AS x FROM (VALUES (75), (90), (95)) t(quality)
), s AS (
  SELECT quality, 'y1' AS plane, dc[x + 1] AS d, ac[x + 1] AS a, 96 AS bd, 110 AS ba FROM q, l
  UNION ALL SELECT quality, 'y2', 2 * dc[x + 1], greatest(8, ac[x + 1] * 155 // 100), 96, 108 FROM q, l
  UNION ALL SELECT quality, 'uv', dc[least(117, greatest(0, x - 2)) + 1], ac[x + 1], 110, 115 FROM q, l
), k AS (SELECT quality, plane, k, CASE k WHEN 0 THEN d ELSE a END AS q, CASE k WHEN 0 THEN bd ELSE ba END << 9 AS bias FROM s, (SELECT unnest(generate_series(0, 15)) AS k))
SELECT quality, plane, k::INT AS k, q::BIGINT AS q, (131072 // q)::BIGINT AS iq, bias::BIGINT AS bias, ((131071 - bias) // (131072 // q))::BIGINT AS zero,
  CASE WHEN plane = 'y1' THEN (sh[k + 1] * q) >> 11 ELSE 0 END::BIGINT AS sharpen, ((sum(q) OVER (PARTITION BY quality, plane))::BIGINT + 8) >> 4 AS q_avg FROM k, l""",
    "size_histogram": f"WITH {_SIZES} SELECT ((h + 15) // 16)::INT AS mb_h, ((w + 15) // 16)::INT AS mb_w, count(*) AS n FROM sizes GROUP BY ALL",
    "batch_assignment": f"""WITH {_SIZES}, r AS (SELECT rel, ((w + 15) // 16)::INT AS mb_w, (row_number() OVER (PARTITION BY (w + 15) // 16 ORDER BY rel) - 1) // 16 AS batch_id FROM sizes)
SELECT mb_w, batch_id, count(*) AS n, min(rel) AS first, max(rel) AS last FROM r GROUP BY mb_w, batch_id""",
    "raw_size_adam7": f"""WITH {_SIZES}, s AS (SELECT rel, w, h, [1, 3, 2, 4][w % 4 + 1] * CASE h % 2 WHEN 0 THEN 8 ELSE 16 END AS bits FROM sizes),
p(r, c, dr, dc) AS (VALUES (0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)),
x AS (SELECT rel, bits, greatest(0, (h - r + dr - 1) // dr) AS hh, greatest(0, (w - c + dc - 1) // dc) AS ww FROM s, p)
SELECT rel, any_value(plain)::BIGINT AS plain, sum(CASE WHEN hh > 0 AND ww > 0 THEN hh * (1 + (ww * bits + 7) // 8) ELSE 0 END)::BIGINT AS interlaced FROM x JOIN (SELECT rel, h * (1 + (w * bits + 7) // 8) AS plain FROM s) USING (rel) GROUP BY rel""",
    "byte_groups": f"""WITH RECURSIVE {_INPUTS}, o AS (SELECT page_id % 3 AS k, size, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS n FROM inputs),
g AS (SELECT k, n, size, 0 AS grp, size AS held FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, o.size, CASE WHEN g.held > 0 AND g.held + o.size > 65536 THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.held > 0 AND g.held + o.size > 65536 THEN o.size ELSE g.held + o.size END FROM g JOIN o ON o.k = g.k AND o.n = g.n + 1)
SELECT k::INT AS k, 0::BIGINT AS batch_id, grp::BIGINT AS group_id, count(*) AS n, sum(size)::BIGINT AS bytes FROM g GROUP BY k, grp""",
    "size_gates": f"""WITH {_SIZES}, g AS (SELECT w * 6::BIGINT AS w, h * 6::BIGINT AS h FROM sizes)
SELECT w * h > 24000000 AS too_large, w % 2 = 1 OR h % 2 = 1 AS odd, w % 16 = 0 AND h % 16 = 0 AS aligned, count(*) AS n FROM g GROUP BY ALL""",
    "largest_group": f"""WITH {_SIZES}, n AS (SELECT w, h, count(*) AS n FROM sizes GROUP BY w, h), r AS (SELECT *, h > w AS portrait, row_number() OVER (PARTITION BY h > w ORDER BY n DESC, w, h) AS k FROM n)
SELECT portrait, w, h, n FROM r WHERE k = 1""",
    "skip_existing": f"WITH {_INPUTS} SELECT rel, out_path FROM outs ANTI JOIN existing USING (out_path)",
    "delete_candidates": f"WITH {_INPUTS} SELECT rel, out_path FROM outs SEMI JOIN existing USING (out_path) WHERE page_id % 3 <> 1",
    "first_writer": f"WITH {_INPUTS}, r AS (SELECT out_path, rel, size, row_number() OVER (PARTITION BY out_path ORDER BY rel, size) AS n FROM outs) SELECT out_path, rel, size FROM r WHERE n = 1",
    "path_collisions": f"WITH {_INPUTS} SELECT out_path, count(*) AS n FROM outs GROUP BY out_path HAVING count(*) > 1",
    "corpus_union": f"WITH {_INPUTS} SELECT CASE page_id % 3 WHEN 1 THEN '.jpg' ELSE '.png' END AS ext, count(*) AS n, sum(size)::BIGINT AS size FROM inputs GROUP BY 1",
    "meta_diff": """WITH a AS (SELECT conv_id, turn, md5(text) AS raw FROM conversations WHERE turn % 5 <> 4), b AS (SELECT conv_id, turn, CASE WHEN conv_id % 10 = 3 THEN 'x' ELSE md5(text) END AS raw2 FROM conversations WHERE turn % 7 <> 6)
SELECT conv_id, CASE WHEN raw IS NULL THEN 'added' WHEN raw2 IS NULL THEN 'lost' WHEN raw = raw2 THEN 'same' ELSE 'changed' END AS what, count(*) AS n FROM a FULL JOIN b USING (conv_id, turn) GROUP BY ALL""",
    "md5_check": "SELECT page_id, md5(html) AS md5 FROM pages",
    "adler32": """WITH b AS (SELECT page_id, encode(html) AS e, octet_length(encode(html)) AS n FROM pages), x AS (SELECT page_id, n, i, ('0x' || substr(hex(e), 2 * i - 1, 2))::INT AS v FROM b, LATERAL (SELECT unnest(generate_series(1, n)) AS i))
SELECT page_id, (((any_value(n) + sum((n - i + 1) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler FROM x GROUP BY page_id""",
    "format_sniff": """WITH s(format) AS (VALUES ('jpeg'), ('webp'), ('bmp'), ('tiff'), ('tiff'), ('gif'), ('gif'), ('j2k'), ('jxl'), ('jxl'), ('avif'), ('heif'), ('dds'), ('qoi'), ('png'), (NULL))
SELECT format, count(*) AS n FROM (SELECT format FROM s UNION ALL SELECT NULL FROM pages) GROUP BY format""",
    "png_headers": f"""WITH {_PICTURES} SELECT vec_id, w, h, CASE WHEN vec_id % 5 = 0 THEN 16 ELSE 8 END::INT AS depth, color::INT AS color, (vec_id % 2)::INT AS interlace, 1::INT AS mb_h, 1::INT AS mb_w, true AS legal, false AS native FROM pic""",
    "png_chunks": """SELECT type, sum(n)::BIGINT AS n, sum(n)::BIGINT AS ok FROM (SELECT unnest(['IHDR', 'IDAT', 'IEND']) AS type, 1 AS n FROM embeddings UNION ALL SELECT unnest(['tEXt', 'pHYs']), 1 FROM embeddings WHERE vec_id % 3 = 0) GROUP BY type""",
    "png_decode": f"""WITH {_PICTURES} SELECT vec_id, sum(px)::BIGINT AS red, sum(CASE WHEN color >= 4 THEN 255 - px ELSE 255 END)::BIGINT AS alpha, bool_and(color < 4 OR px = 0) AS opaque FROM pic JOIN plane USING (vec_id) WHERE pos % 8 < w AND pos // 8 < h GROUP BY vec_id""",
    "png_text": "SELECT vec_id, 'Title' AS key, 'picture ' || vec_id::VARCHAR AS value, 2835::BIGINT AS per_meter FROM embeddings WHERE vec_id % 3 = 0",
    "entropy_bits": """WITH c AS (SELECT lang, unnest(string_split(text, '')) AS b FROM documents), h AS (SELECT lang, b, count(*) AS n FROM c WHERE b <> '' GROUP BY lang, b),
t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM h) SELECT lang, sum(n)::BIGINT AS letters, round(sum(-n * log2(n / t)) / sum(n), 6) AS bits FROM t GROUP BY lang""",
    "prefix_code": """WITH v AS (SELECT i AS value, i - 1 AS v, CASE WHEN i > 4 THEN floor(log2(i - 1 + 0.5))::INT END AS top FROM generate_series(1, 4096) t(i))
SELECT value, CASE WHEN v < 4 THEN v ELSE 2 * top + (v >> (top - 1)) % 2 END::INT AS symbol, CASE WHEN v < 4 THEN 0 ELSE top - 1 END::INT AS bits, CASE WHEN v < 4 THEN 0 ELSE v % (1 << (top - 1)) END::BIGINT AS extra FROM v""",
    "canonical_codes": """WITH l AS (SELECT i AS sym, CASE WHEN i < 2 THEN 2 WHEN i < 5 THEN 3 WHEN i < 6 THEN 4 ELSE 8 END AS len FROM generate_series(0, 15) t(i))
SELECT a.sym::INT AS sym, a.len::INT AS len, (coalesce((SELECT sum(1 << (15 - b.len)) FROM l b WHERE (b.len, b.sym) < (a.len, a.sym)), 0)::BIGINT >> (15 - a.len)) AS code FROM l a""",
    "huffman_bits": """WITH RECURSIVE h AS (SELECT lang, b, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS b FROM documents) WHERE b <> '' GROUP BY ALL),
m AS (SELECT lang, list_sort(list(n)) AS q, 0::BIGINT AS bits FROM h GROUP BY lang UNION ALL SELECT lang, list_sort(list_append(q[3:], q[1] + q[2])), bits + q[1] + q[2] FROM m WHERE len(q) > 1)
SELECT lang, bits::BIGINT AS bits FROM m WHERE len(q) = 1""",
    "prob_update_fit": f"""WITH {_LEVELS}, n AS (SELECT k, count(*) FILTER (level = 0) AS n0, count(*) FILTER (level <> 0) AS n1 FROM lv GROUP BY k),
p AS (SELECT *, least(255, greatest(1, (n0 * 256 + (n0 + n1) // 2) // (n0 + n1)))::INT AS new_p FROM n), b AS (SELECT *, (n0 + n1)::DOUBLE + n0 * log2(new_p / 256.0) + n1 * log2(1 - new_p / 256.0) AS s FROM p)
SELECT k, n0, n1, new_p, round(s, 4) AS saved, n0 + n1 >= 24 AND s > 14 AS send FROM b""",
    "alpha_roundtrip": f"WITH {_PLANE} SELECT vec_id, sum((px >> 6) << 6)::BIGINT AS total, true AS same FROM plane GROUP BY vec_id",
    "xmp_build": f"""WITH {_PACKET}, f AS (SELECT conv_id, i, {_escaped('key')} AS key, {_escaped('text')} AS v, base64(encode(text)) AS raw FROM t),
x AS (SELECT conv_id, count(*) AS n, string_agg('<rdf:li rdf:parseType="Resource"><chunk:kind>tEXt</chunk:kind><chunk:keyword>' || key || '</chunk:keyword><chunk:content>' || v || '</chunk:content><chunk:payload>' || raw || '</chunk:payload></rdf:li>', '' ORDER BY i) AS s FROM f GROUP BY conv_id)
SELECT conv_id, n, md5('<?xpacket begin="' || chr(65279) || '" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:chunk="urn:rastrel:chunks"><chunk:list><rdf:Seq>'
  || s || '</rdf:Seq></chunk:list></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>') AS md5 FROM x""",
    "xmp_parse": f"WITH {_PACKET} SELECT conv_id, i::INT AS i, key, text AS value, md5(text) AS md5 FROM t",
    "outcome_rollup": f"""WITH {_OUTCOMES} SELECT (user_id % 10)::INT AS worker, count(*) AS total, count(*) FILTER (status = 'ok') AS done, count(*) FILTER (status = 'fallback') AS fallbacks, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
sum(src_bytes)::BIGINT AS src_bytes, sum(dst_bytes)::BIGINT AS dst_bytes, round(sum(dst_bytes) / sum(src_bytes), 6) AS ratio, round(100 * (1 - sum(dst_bytes) / sum(src_bytes)), 4) AS saved_percent FROM o GROUP BY 1""",
    "progress_window": f"""WITH {_OUTCOMES}, h AS (SELECT date_trunc('hour', ts) AS hour, status, count(*) AS n, min(src_bytes) AS least FROM o GROUP BY ALL)
SELECT hour, status, n, (sum(n) OVER (PARTITION BY status ORDER BY hour))::BIGINT AS so_far, min(least) OVER (PARTITION BY status ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS least_of_3 FROM h""",
    "verify_gate": """WITH e AS (SELECT event_id, user_id, round(value % 20, 2) + 30 AS p FROM events),
n AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'size' WHEN user_id % 13 = 0 THEN 'alpha' WHEN event_id % 7 = 0 THEN 'metadata' WHEN p < 34 THEN 'PSNR' END AS note, CASE WHEN event_id % 3 = 0 THEN 'metadata' WHEN p + 2 < 34 THEN 'PSNR' END AS b FROM e)
SELECT note, CASE WHEN note IS NULL THEN 'ok' WHEN b IS NULL OR b = 'PSNR' THEN 'fallback' ELSE 'fail' END AS status, count(*) AS n FROM n GROUP BY ALL""",
    "keep_smaller": """WITH e AS (SELECT event_id, floor(value)::BIGINT AS a, floor(value * 0.9::DOUBLE)::BIGINT AS b, event_id % 4 AS p FROM events WHERE value IS NOT NULL)
SELECT event_id, CASE WHEN p > 0 AND b < a THEN 2 ELSE 1 END::INT AS attempt, CASE WHEN p > 0 AND b < a THEN b ELSE a END AS size FROM e""",
    "rate_scale": """WITH e AS (SELECT (floor(value * 10)::BIGINT % 100) / 10.0::DOUBLE + 38 AS p FROM events) SELECT round(sqrt(least(8.0::DOUBLE, exp((p - 40) / 1.15::DOUBLE))), 2) AS root, count(*) AS n FROM e WHERE p > 40.15::DOUBLE GROUP BY 1""",
    "convert_corpus": f"""WITH {_PLANE}, pic AS (SELECT DISTINCT vec_id // 24 AS p FROM embeddings), size AS (SELECT p, (48 - p % 5)::INT AS w, (32 - p % 3)::INT AS h FROM pic),
px AS (SELECT vec_id // 24 AS p, vec_id % 24 // 6 * 8 + pos // 8 AS y, vec_id % 24 % 6 * 8 + pos % 8 AS x, px FROM plane),
s AS (SELECT p, sum(px)::BIGINT AS total FROM px JOIN size USING (p) WHERE x < w AND y < h GROUP BY p)
SELECT 't/' || (p % 10)::VARCHAR || '/' || p::VARCHAR || '.png' AS rel, 't/' || (p % 10)::VARCHAR || '/' || p::VARCHAR || '.webp' AS out_path, w, h, p % 3 = 0 OR (p % 4 >= 2 AND total > 0) AS extended,
  (255 * w * h - CASE WHEN p % 4 >= 2 THEN total ELSE 0 END)::BIGINT AS alpha, CASE WHEN p % 3 = 0 THEN 'Title' END AS key, CASE WHEN p % 3 = 0 THEN 'picture ' || p::VARCHAR END AS value, CASE WHEN p % 3 = 0 THEN 2835::BIGINT END AS per_meter
FROM size JOIN s USING (p)""",
    "batch_slices": f"""WITH {_SIZES} SELECT ((w + 15) // 16)::INT AS mb_w, rel, (row_number() OVER (PARTITION BY (w + 15) // 16 ORDER BY rel) - 1) // 16 AS batch_id FROM sizes""",
    "byte_slices": f"""WITH RECURSIVE {_INPUTS}, o AS (SELECT page_id, page_id % 3 AS k, size, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS n FROM inputs),
g AS (SELECT k, n, page_id, 0 AS grp, size AS held FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, o.page_id, CASE WHEN g.held > 0 AND g.held + o.size > 16384 THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.held > 0 AND g.held + o.size > 16384 THEN o.size ELSE g.held + o.size END FROM g JOIN o ON o.k = g.k AND o.n = g.n + 1)
SELECT k::INT AS k, page_id, grp::BIGINT AS group_id FROM g""",
    "crc_sample": f"""WITH RECURSIVE {_INPUTS}, step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM generate_series(0, 255) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
crc AS (SELECT rel, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode(rel)), 2 * j - 1, 2))::BIGINT FOR j IN generate_series(1, strlen(rel))]), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])) AS c FROM inputs, tab)
SELECT rel FROM crc WHERE xor(c, 4294967295) % 100 < 10""",
}
SQL["iwht"] = f"""WITH f AS ({SQL["fwht"]}), z AS (SELECT mb, k // 4 AS i, k % 4 AS j, c FROM f), p1 AS ({_four('z', 'mb, j', 'i', 'c')}), p2 AS ({_union('p1', 'mb, j', 'i', 't', _BACK)}),
p3 AS (SELECT mb, i, j, t + CASE WHEN j = 0 THEN 3 ELSE 0 END AS t FROM p2), p4 AS ({_four('p3', 'mb, i', 'j', 't')}), p5 AS ({_union('p4', 'mb, i', 'j', 'dc', [f'({x}) >> 3' for x in _BACK])})
SELECT mb, (i * 4 + j)::INT AS k, dc::BIGINT AS dc FROM p5"""
