"""SQL of the queries in `extended`, for an independent engine."""

from __future__ import annotations

from .sql import _BAYES, _JOINT, _TRUNC, K, PARTS, build
from .sql import ORACLE_SQL as _FIRST

_WIDEN = "CASE WHEN a = b THEN greatest(a - 1, 0) ELSE a END AS lo, CASE WHEN a = b THEN least(b + 1, 255) ELSE b END AS hi"
_WAY = "CASE WHEN {0} > 10 THEN 2 WHEN {0} < -10 THEN 0 ELSE 1 END"
_STRENGTH = "CASE WHEN abs(gx) + abs(gy) < 5 THEN 0 WHEN abs(gx) + abs(gy) < 20 THEN 1 WHEN abs(gx) + abs(gy) < 50 THEN 2 WHEN abs(gx) + abs(gy) < 100 THEN 3 ELSE 4 END"
_RAWBIN = f"({_WAY.format('gx')}) * 15 + ({_WAY.format('gy')}) * 5 + {_STRENGTH}"
_LEVEL5 = "CASE WHEN p >= 224 THEN 4 WHEN p >= 192 THEN 3 WHEN p >= 128 THEN 2 WHEN p >= 64 THEN 1 ELSE 0 END"
_ARGMAX = "SELECT {keys}, arg_max(cls, s) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY v, cls DESC) AS s FROM ({rows})) GROUP BY {keys}"


def _best(rows: str, keys: str = "qid, label", part: str = "qid") -> str:
    """The class of the largest v of (keys, cls, v); of equals the lowest."""
    return _ARGMAX.format(rows=rows, keys=keys, part=part)


def _l1(name: str, value: str = "n") -> str:
    """Negative distance of sparse counts (id, bin, value) for each candidate pair: both sums less twice the smaller counts."""
    return f"""SELECT t.qid, t.tid, CAST(-(a.s + b.s - 2 * coalesce(m.m, 0)) AS BIGINT) AS sim FROM top t JOIN (SELECT id, sum({value}) AS s FROM {name} GROUP BY id) a ON a.id = t.qid
        JOIN (SELECT id, sum({value}) AS s FROM {name} GROUP BY id) b ON b.id = t.tid LEFT JOIN (SELECT u.qid, u.tid, sum(least(c.{value}, d.{value})) AS m FROM top u JOIN {name} c ON c.id = u.qid
        JOIN {name} d ON d.id = u.tid AND d.bin = c.bin GROUP BY u.qid, u.tid) m ON m.qid = t.qid AND m.tid = t.tid"""


_COLOUR = {
    "turns": "SELECT id, list(p ORDER BY pos) AS px FROM cell GROUP BY id",
    "rgb": "SELECT c.id, c.label, c.q, c.pos, c.y, c.x, c.p AS r, l.px[(c.pos + 21) % 64 + 1] AS g, l.px[(c.pos + 42) % 64 + 1] AS b FROM cell c JOIN turns l ON l.id = c.id",
    "inter": "SELECT id, label, q, CAST(y * 24 + x * 3 + k AS INT) AS pos, y, CAST(x * 3 + k AS INT) AS x, CASE k WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS p, k FROM rgb, range(3) z(k)",
    "plane": "SELECT id, 'r' AS c, y, x, r AS p FROM rgb UNION ALL SELECT id, 'g', y, x, g FROM rgb UNION ALL SELECT id, 'b', y, x, b FROM rgb",
    "pstep": """SELECT *, CASE WHEN x = 7 THEN 0 ELSE lead(p) OVER (PARTITION BY id, c, y ORDER BY x) - p END AS gx, CASE WHEN y = 7 THEN 0 ELSE lead(p) OVER (PARTITION BY id, c, x ORDER BY y) - p END AS gy FROM plane""",
    "chist": f"SELECT id, c AS channel, CAST(y * 2 // 8 * 2 + x * 2 // 8 AS INT) AS region, CAST({_RAWBIN} AS INT) AS bin, count(*) AS n FROM pstep GROUP BY 1, 2, 3, 4",
    "pgrad": """SELECT *, CASE WHEN x = 7 THEN 0 ELSE greatest(-1, least(1, lead(t) OVER (PARTITION BY id, c, y ORDER BY x) - t)) END AS h, CASE WHEN y = 7 THEN 0 ELSE greatest(-1, least(1, lead(t) OVER (PARTITION BY id, c, x ORDER BY y) - t)) END AS v
        FROM (SELECT *, CASE WHEN p > 170 THEN 1 WHEN p < 85 THEN -1 ELSE 0 END AS t FROM plane)""",
}


def _per_plane(low: int, high: int) -> str:
    return f"""SELECT i.id, i.label, i.q, i.pos, i.y, i.x, CASE WHEN i.p > z.hi THEN 1 WHEN i.p < z.lo THEN -1 ELSE 0 END AS t FROM inter i JOIN (SELECT id, k, {_WIDEN} FROM (
        SELECT id, k, s[{low}] AS a, s[{high}] AS b FROM (SELECT id, k, list_sort(list(p)) AS s FROM inter GROUP BY id, k))) z ON z.id = i.id AND z.k = i.k"""


_CURL = "SELECT id, y, x, coalesce(lead(vg) OVER (PARTITION BY id, y ORDER BY x), 0) - vg - (coalesce(lead(hg) OVER (PARTITION BY id, x ORDER BY y), 0) - hg) AS c FROM grad"
_HIST4 = f"SELECT id, y * 4 // 8 AS ry, x * 4 // 8 AS rx, CAST({_RAWBIN} AS INT) AS bin, count(*) AS n FROM stepped GROUP BY 1, 2, 3, 4"
_JET = """SELECT id, CAST((y * 2 // 8 * 2 + x * 2 // 8) * 7 + CASE WHEN abs(fxx) + abs(fyy) + abs(fxy) > 0 THEN CASE WHEN det > 0 THEN CASE WHEN tr < 0 THEN 2 ELSE 3 END WHEN det < 0 THEN 4 WHEN tr < 0 THEN 5 ELSE 6 END
    WHEN abs(fx) + abs(fy) > 0 THEN 1 ELSE 0 END AS INT) AS bin, count(*) AS n FROM (SELECT *, fxx * fyy - fxy * fxy AS det, fxx + fyy AS tr FROM (
    SELECT c.id, c.y, c.x, l[pos + 2] - l[pos] AS fx, l[pos + 9] - l[pos - 7] AS fy, l[pos + 2] - 2 * c.t + l[pos] AS fxx, l[pos + 9] - 2 * c.t + l[pos - 7] AS fyy, l[pos + 10] - l[pos + 8] - l[pos - 6] + l[pos - 8] AS fxy
    FROM tern c JOIN (SELECT id, list(t ORDER BY pos) AS l FROM tern GROUP BY id) z ON z.id = c.id WHERE c.x BETWEEN 1 AND 6 AND c.y BETWEEN 1 AND 6)) GROUP BY 1, 2"""
_BANDS = """SELECT id, CAST(least(32767, sum(abs((a + b) // 2))) AS INT) AS dc, CAST(least(32767, sum(f)) AS INT) AS fine, CAST(least(32767, sum(m)) AS INT) AS mid, CAST(least(32767, sum(abs(a - b))) AS INT) AS coarse FROM (
    SELECT id, y, f, abs(m1 - m2) + abs(m3 - m4) AS m, (m1 + m2) // 2 AS a, (m3 + m4) // 2 AS b FROM (
    SELECT id, y, (l[1] + l[2]) // 2 AS m1, (l[3] + l[4]) // 2 AS m2, (l[5] + l[6]) // 2 AS m3, (l[7] + l[8]) // 2 AS m4, abs(l[1] - l[2]) + abs(l[3] - l[4]) + abs(l[5] - l[6]) + abs(l[7] - l[8]) AS f
    FROM (SELECT id, y, list(p ORDER BY x) AS l FROM cell WHERE y BETWEEN 2 AND 5 GROUP BY id, y))) GROUP BY id"""
_TERMS = {
    "lbp": _FIRST["local_pattern"], "haar": _FIRST["haar_energy"], "goh": _FIRST["orientation"], "gmt": _FIRST["gradient_state_steps"], "symm": _FIRST["symmetry"], "glcm": _FIRST["contrast"], "bands": _BANDS,
    "l_lbp": _l1("lbp"), "l_haar": _l1("haar", "e"), "l_goh": _l1("goh"), "l_gm": _l1("gm"), "l_gmt": _l1("gmt"),
    "sims": """SELECT t.qid, t.tid, l_lbp.sim AS lbp_sim, l_haar.sim AS haar_sim, l_goh.sim AS goh_sim, CAST(-(abs(ba.dc - bb.dc) + abs(ba.fine - bb.fine) + abs(ba.mid - bb.mid) + abs(ba.coarse - bb.coarse)) AS BIGINT) AS cwht_sim,
        CAST(-abs(sa.s - sb.s) AS BIGINT) AS symm_sim, CAST(-(abs(ga.h - gb.h) + abs(ga.v - gb.v) + abs(ga.d - gb.d)) AS BIGINT) AS glcm_sim, l_gm.sim AS gm_sim, l_gmt.sim AS gmt_sim
        FROM top t JOIN l_lbp ON l_lbp.qid = t.qid AND l_lbp.tid = t.tid JOIN l_haar ON l_haar.qid = t.qid AND l_haar.tid = t.tid JOIN l_goh ON l_goh.qid = t.qid AND l_goh.tid = t.tid
        JOIN l_gm ON l_gm.qid = t.qid AND l_gm.tid = t.tid JOIN l_gmt ON l_gmt.qid = t.qid AND l_gmt.tid = t.tid JOIN bands ba ON ba.id = t.qid JOIN bands bb ON bb.id = t.tid
        JOIN symm sa ON sa.id = t.qid JOIN symm sb ON sb.id = t.tid JOIN glcm ga ON ga.id = t.qid JOIN glcm gb ON gb.id = t.tid""",
}


def _scored(weights: dict[str, int]) -> dict[str, str]:
    terms = " + ".join(f"({50 * w} // (50 + mad)) * {c}" for c, w in weights.items())
    return _TERMS | {"scored": f"SELECT *, CAST(256 * dot_px + 192 * dot_vg + {terms} AS BIGINT) AS combined FROM feat JOIN madv USING (qid) JOIN sims USING (qid, tid)"}


# The weights of the scores, as in the queries.
_TEXTURE = _scored({"cent_sim": 50, "prof_sim": 16, "div_sim": 200, "gdiv_sim": 100, "lbp_sim": 25, "haar_sim": 2, "goh_sim": 25, "cwht_sim": 4, "symm_sim": 2, "glcm_sim": 10})
_GAUSS = _scored({"div_sim": 200, "cent_sim": 50, "gdiv_sim": 100, "gm_sim": 50, "gmt_sim": 25})
_SPECTRUM = {"had": "SELECT id, label, q, CAST(u AS INT) AS u, sum(CASE WHEN bit_count((pos & u)::INT) % 2 = 1 THEN -t ELSE t END) AS coef FROM tern, range(64) r(u) GROUP BY id, label, q, u"}
_DOT = "SELECT t.qid, t.tid, CAST(sum(a.coef * b.coef) AS BIGINT) AS dot FROM top t JOIN had a ON a.id = t.qid JOIN had b ON b.id = t.tid AND b.u = a.u {where} GROUP BY 1, 2"
_DIGITS = "SELECT id, pos, b // 27 - 1 AS d3, b // 9 % 3 - 1 AS d2, b // 3 % 3 - 1 AS d1, b % 3 - 1 AS d0 FROM (SELECT id, pos, p * 81 // 256 AS b FROM cell) z"
_DIGIT_DOT = "SELECT t.qid, t.tid, CAST(sum({f}) AS BIGINT) AS dot FROM top t JOIN dig a ON a.id = t.qid JOIN dig b ON b.id = t.tid AND b.pos = a.pos GROUP BY 1, 2"
_TRIT = "CASE WHEN {0}.n - g.mean > g.dev THEN 1 WHEN {0}.n - g.mean < -g.dev THEN -1 ELSE 0 END"
_CELLS = {"cells": """SELECT h.qid, h.label, h.channel, h.pos, cls, coalesce(cnt, 0) AS c FROM hotq h CROSS JOIN cls LEFT JOIN hot ON hot.channel = h.channel AND hot.pos = h.pos AND hot.val = h.val AND hot.label = cls"""}
_SOFT = "exp(({c} - {t}) / {temp}::DOUBLE) / sum(exp(({c} - {t}) / {temp}::DOUBLE)) OVER (PARTITION BY qid)"


def _update(part: str, c: str, temp: int) -> str:
    floored = f"SELECT *, greatest(post * ({_SOFT.format(c=c, t='t' + c, temp=temp)}), 1e-10::DOUBLE) AS f FROM {part}"
    return f"SELECT qid, label, cls, p, h, v, tp, th, tv, f / sum(f) OVER (PARTITION BY qid) AS post FROM ({floored})"


_MEANS = "SELECT label, pos, sum(t) AS s, count(*) AS n FROM tern WHERE NOT q GROUP BY label, pos"
_PROTO = "SELECT label, pos, CASE WHEN s > n // 3 THEN 1 WHEN s < -(n // 3) THEN -1 ELSE 0 END AS proto FROM means"
_PAIRS = {  # weights of all pairs, as in the pair revote
    "two": "SELECT r.a::INT AS a, s.b::INT AS b, channel, pos, val, label, cnt FROM range(10) r(a), range(10) s(b), hot WHERE r.a < s.b AND label IN (r.a, s.b)",
    "pairs": """SELECT a, b, channel, pos, CASE WHEN most > 0 THEN greatest(1, CAST(floor(round(raw / most * 16, 6) + 0.5) AS INT)) ELSE 1 END AS w FROM (
        SELECT *, max(raw) OVER (PARTITION BY a, b, channel) AS most FROM (SELECT a, b, channel, pos, round(hc - he / tot, 9) AS raw FROM (
          SELECT a, b, channel, pos, sum(-n / tot * log2(n / tot)) AS hc, sum(n) AS tot FROM (
            SELECT a, b, channel, pos, label, CAST(sum(cnt) AS DOUBLE) AS n, CAST(sum(sum(cnt)) OVER (PARTITION BY a, b, channel, pos) AS DOUBLE) AS tot FROM two GROUP BY a, b, channel, pos, label) GROUP BY a, b, channel, pos) x
        JOIN (SELECT a, b, channel, pos, sum(CASE WHEN val = bg THEN 0.0 ELSE e END) AS he FROM (
            SELECT *, -cnt * log2(cnt / CAST(sum(cnt) OVER (PARTITION BY a, b, channel, pos, val) AS DOUBLE)) AS e FROM two) JOIN bg USING (channel) GROUP BY a, b, channel, pos) y USING (a, b, channel, pos)))""",
}
_NB = "SELECT h.qid, h.label, cls, round(sum(ln(coalesce(cnt, 0) + 0.5)), 9) AS v FROM hotq h CROSS JOIN cls LEFT JOIN hot ON hot.channel = h.channel AND hot.pos = h.pos AND hot.val = h.val AND hot.label = cls GROUP BY h.qid, h.label, cls"
_KNN = "SELECT {keys}, label, arg_max(tlabel, n * 100 - tlabel) AS pred FROM (SELECT {keys}, label, tlabel, count(*) AS n FROM ({rows}) GROUP BY {keys}, label, tlabel) GROUP BY {keys}, label"
_EYES = [
    {"tern": "SELECT *, CASE WHEN p > 170 THEN 1 WHEN p < 85 THEN -1 ELSE 0 END AS t FROM inter"},
    {"tern": f"SELECT i.*, CASE WHEN i.p > z.hi THEN 1 WHEN i.p < z.lo THEN -1 ELSE 0 END AS t FROM inter i JOIN (SELECT id, {_WIDEN} FROM (SELECT id, s[65] AS a, s[129] AS b FROM (SELECT id, list_sort(list(p)) AS s FROM inter GROUP BY id))) z ON z.id = i.id"},
    {"tern": _per_plane(22, 43)},
]
_WIDE_EYE = _COLOUR | {"sig": "SELECT id, label, q, 'px' AS channel, CAST(y * 8 + x // 3 AS INT) AS pos, CAST(sum((t + 1) * CASE x % 3 WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 1 END) AS INT) AS val FROM tern GROUP BY id, label, q, y, x // 3"}
_EYE_VOTES = " UNION ALL ".join(f"SELECT * FROM ({build('SELECT qid, tid, tlabel, votes FROM votes3', _WIDE_EYE | e)})" for e in _EYES)
_CASCADE = _COLOUR | {
    "eyes": f"SELECT qid, tid, tlabel, sum(votes) AS votes FROM ({_EYE_VOTES}) GROUP BY qid, tid, tlabel",
    "best": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, tid) AS rank FROM eyes) WHERE rank <= {K}",
    "far": """SELECT b.qid, b.tid, b.tlabel, b.votes, 2 * 192 - 2 * coalesce(m.m, 0) AS d FROM best b LEFT JOIN (SELECT u.qid, u.tid, sum(least(c.n, e.n)) AS m FROM best u JOIN chist c ON c.id = u.qid
        JOIN chist e ON e.id = u.tid AND e.channel = c.channel AND e.region = c.region AND e.bin = c.bin GROUP BY u.qid, u.tid) m ON m.qid = b.qid AND m.tid = b.tid""",
    "near": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, votes DESC, tid) AS place FROM far",
}
_COARSE = {"cell0": PARTS["cell"], "cell": "SELECT id, label, q, CAST(y // 2 * 4 + x // 2 AS INT) AS pos, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(sum(p) // 4 AS INT) AS p FROM cell0 GROUP BY id, label, q, y // 2, x // 2",
           "sig": "SELECT id, label, q, 'px' AS channel, y AS pos, CAST(sum((t + 1) * CASE x % 3 WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 1 END) AS INT) AS val FROM tern WHERE x < 3 GROUP BY id, label, q, y"}
_SCORES = "SELECT qid, label, cls, score FROM hs WHERE channel = 'px'"


def _dual(sig: str) -> str:
    """Scores of a cube over signatures (id, label, q, pos, val), of all classes."""
    return f"""SELECT s.id AS qid, s.label, cls, sum(coalesce(h.cnt, 0)) AS v FROM (SELECT * FROM {sig} WHERE q) s CROSS JOIN cls LEFT JOIN (SELECT pos, val, label, count(*) AS cnt FROM {sig} WHERE NOT q GROUP BY pos, val, label) h
        ON h.pos = s.pos AND h.val = s.val AND h.label = cls GROUP BY s.id, s.label, cls"""


_QC = "CASE WHEN n <= 2 THEN n WHEN n <= 4 THEN 3 WHEN n <= 8 THEN 4 WHEN n <= 16 THEN 5 ELSE 6 END"
_BRUTE = """SELECT qid, tid, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {way}, tid) AS rank FROM (
    SELECT a.id AS qid, b.id AS tid, CAST(sum({f}) AS BIGINT) AS score FROM cell a JOIN cell b ON b.pos = a.pos WHERE a.q AND NOT b.q GROUP BY 1, 2)) WHERE rank <= 10"""
_HEX = "CAST('0x' || substr(md5({0}), 1, {1}) AS BIGINT)"
_MARGIN = "SELECT qid, label, arg_max(cls, score * 100 - cls) AS pred, list_sort(list(score), 'DESC')[1] - list_sort(list(score), 'DESC')[2] AS gap FROM hsum GROUP BY qid, label"
_SWEEP_STATIC = """SELECT g, wc, wp, wd, wg, sc, qid, label, tlabel, row_number() OVER (PARTITION BY g, wc, wp, wd, wg, sc, qid ORDER BY 256 * dot_px + 192 * dot_vg + (sc * wc // (sc + mad)) * cent_sim + (sc * wp // (sc + mad)) * prof_sim
    + (sc * wd // (sc + mad)) * div_sim + (sc * wg // (sc + mad)) * CASE WHEN g = 0 THEN gdiv_sim ELSE other END DESC, votes DESC, tid) AS place
    FROM (SELECT * FROM feat JOIN madv USING (qid) JOIN g3 USING (qid, tid) WHERE qid < 250) f, (VALUES (0), (1)) a(g), (VALUES (0), (25), (50), (100)) b(wc), (VALUES (0), (8), (16)) c(wp),
    (VALUES (50), (100), (200), (400)) d(wd), (VALUES (50), (100), (200), (400)) e(wg), (VALUES (20), (50), (100)) h(sc)"""
_STATIC = {
    "gd3": "SELECT id, y * 3 // 8 * 3 + x * 3 // 8 AS region, sum(CASE WHEN d < 0 THEN d ELSE 0 END) AS s FROM dcell GROUP BY id, 2",
    "g3": "SELECT qid, tid, -sum(abs(a.s - b.s)) AS other FROM top JOIN gd3 a ON a.id = qid JOIN gd3 b ON b.id = tid AND b.region = a.region GROUP BY qid, tid",
    "swept": _SWEEP_STATIC,
    "answers": "SELECT g, wc, wp, wd, wg, sc, qid, label, arg_max(tlabel, n * 100 - tlabel) AS pred FROM (SELECT g, wc, wp, wd, wg, sc, qid, label, tlabel, count(*) AS n FROM swept WHERE place <= 3 GROUP BY ALL) GROUP BY ALL",
    "found": "SELECT CAST(g AS INT) AS grid, CAST(wc AS INT) AS cent, CAST(wp AS INT) AS prof, CAST(wd AS INT) AS div, CAST(wg AS INT) AS gdiv, CAST(sc AS INT) AS scale, count(*) AS n, CAST(sum(CAST(label = pred AS INT)) AS BIGINT) AS correct FROM answers GROUP BY ALL",
}

_FBV = {
        "fords": "SELECT pos, row_number() OVER (ORDER BY w DESC, pos) AS ord FROM ig WHERE channel = 'px'", "topcls": "SELECT qid, cls FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cls) AS rn FROM hsum) WHERE rn <= 3",
        "fbv": "SELECT p.qid, t.tid, t.tlabel, count(*) AS votes FROM pexact p JOIN fords f ON f.pos = p.pos AND f.ord <= 8 JOIN topcls c ON c.qid = p.qid JOIN post t ON t.channel = p.channel AND t.pos = p.pos AND t.val = p.val AND t.tlabel = c.cls WHERE p.channel = 'px' GROUP BY 1, 2, 3"}

ORACLE_SQL: dict[str, str] = {
    "colour_grey": build("SELECT id, pos, CAST((77 * r + 150 * g + 29 * b) // 256 AS INT) AS v FROM rgb", _COLOUR),
    "colour_interleaved": build("SELECT id, pos, p AS v FROM inter", _COLOUR),
    "quantize_per_plane": build("SELECT id, pos, t AS v FROM pp", _COLOUR | {"pp": _per_plane(22, 43)}),
    "quantize_per_plane_wide": build("SELECT id, pos, t AS v FROM pp", _COLOUR | {"pp": _per_plane(17, 49)}),
    "colour_gradient_signatures": build("""SELECT id, c || k AS channel, CAST(y * 2 + x // 3 AS INT) AS pos, CAST(sum((CASE WHEN k = '_h' THEN h ELSE v END + 1) * CASE x % 3 WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 1 END) AS INT) AS val
        FROM pgrad, (VALUES ('_h'), ('_v')) z(k) WHERE x < 6 GROUP BY id, c, k, y, x // 3""", _COLOUR),
    "pentary_signatures_2": build(f"SELECT id, CAST(y * 4 + x // 2 AS INT) AS pos, CAST(sum(({_LEVEL5}) * CASE x % 2 WHEN 0 THEN 5 ELSE 1 END) AS INT) AS val FROM cell GROUP BY id, y, x // 2"),
    "pentary_signatures_1": build(f"SELECT id, pos, CAST({_LEVEL5} AS INT) AS val FROM cell"),
    "packed_trits": build("SELECT id, CAST(pos // 4 AS INT) AS pos, CAST(sum(CASE t WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END * CASE pos % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 16 ELSE 64 END) AS INT) AS byte FROM tern GROUP BY id, pos // 4"),
    "colour_gradient_map": build("SELECT id, channel, region, bin, n FROM chist", _COLOUR),
    "brute_raw_dot": build(_BRUTE.format(f="a.p * b.p", way="DESC")),
    "brute_l2": build(_BRUTE.format(f="(a.p - b.p) * (a.p - b.p)", way="")),
    "haar_bands": build("SELECT * FROM bands", {"bands": _BANDS}),
    "taylor_jets": build(_JET),
    "curl_histogram": build("SELECT id, CAST(b AS INT) AS bin, CAST(sum(CASE WHEN c + 4 = b THEN 1 ELSE 0 END) AS BIGINT) AS n FROM curls, range(9) r(b) GROUP BY id, b", {"curls": _CURL}),
    "curl_regions": build("SELECT id, CAST(y * 2 // 8 * 4 + x * 4 // 8 AS INT) AS region, CAST(sum(CASE WHEN c < 0 THEN c ELSE 0 END) AS INT) AS s FROM curls GROUP BY id, 2", {"curls": _CURL}),
    "region_curvature": build("""SELECT id, CAST(pair AS INT) AS pair, bin, CAST(sum(d) AS BIGINT) AS d FROM (SELECT id, ry * 3 + rx AS pair, bin, -n AS d FROM h4 WHERE rx < 3 UNION ALL SELECT id, ry * 3 + rx - 1, bin, n FROM h4 WHERE rx > 0
        UNION ALL SELECT id, 12 + ry * 4 + rx, bin, -n FROM h4 WHERE ry < 3 UNION ALL SELECT id, 12 + ry * 4 + rx - 4, bin, n FROM h4 WHERE ry > 0) GROUP BY id, pair, bin HAVING sum(d) <> 0""", {"h4": _HIST4}),
    "region_symmetry": build("""SELECT id, kind, CAST(line AS INT) AS line, bin, CAST(sum(d) AS BIGINT) AS d FROM (SELECT id, 'rows' AS kind, ry AS line, bin, CASE WHEN rx < 2 THEN n ELSE -n END AS d FROM h4
        UNION ALL SELECT id, 'columns', rx, bin, CASE WHEN ry < 2 THEN n ELSE -n END FROM h4) GROUP BY id, kind, line, bin HAVING sum(d) <> 0""", {"h4": _HIST4}),
    "flow_trace_regions": build("""SELECT g.id, CAST(g.y * 4 // 8 * 4 + g.x * 4 // 8 AS INT) AS region, CAST(sum(CASE WHEN hg <> 0 OR vg <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS flow,
        CAST(sum(CASE WHEN g.x < 7 AND g.y < 7 AND abs(c) >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS vortices FROM grad g JOIN curls c ON c.id = g.id AND c.y = g.y AND c.x = g.x GROUP BY 1, 2""", {"curls": _CURL}),
    "texture_similarities": build("SELECT * FROM sims", _TERMS),
    "combined_texture": build("SELECT qid, tid, combined, place FROM ranked", _TEXTURE),
    "knn_texture": build("SELECT qid, label, pred FROM knn", _TEXTURE),
    "bayes_texture": build(_BAYES, _TEXTURE),
    "combined_gauss": build("SELECT qid, tid, combined, place FROM ranked", _GAUSS),
    "bayes_gauss": build(_BAYES.replace("(combined + 100 * (div_sim + gdiv_sim))", "combined"), _GAUSS),
    "delta_similarity": build(f"""SELECT t.qid, t.tid, CAST(-sum(abs(a.n - b.n)) AS BIGINT) AS raw, CAST(sum(CASE WHEN {_TRIT.format('a')} = {_TRIT.format('b')} THEN 1 ELSE 0 END) AS INT) AS matches
        FROM top t JOIN gm a ON a.id = t.qid JOIN gm b ON b.id = t.tid AND b.bin = a.bin JOIN ground g ON g.label = t.tlabel AND g.bin = a.bin GROUP BY 1, 2"""),
    "chi_square": build("""SELECT t.qid, t.tid, round(-sum(CASE WHEN a.n + b.n > 0 THEN CAST((a.n - b.n) * (a.n - b.n) AS DOUBLE) / (a.n + b.n) ELSE 0 END), 6) AS sim FROM top t JOIN gm a ON a.id = t.qid JOIN gm b ON b.id = t.tid AND b.bin = a.bin GROUP BY 1, 2"""),
    "digit_dot": build(_DIGIT_DOT.format(f="27 * a.d3 * b.d3 + 9 * a.d2 * b.d2 + 3 * a.d1 * b.d1 + a.d0 * b.d0"), {"dig": _DIGITS}),
    "digit_dot_two_planes": build(_DIGIT_DOT.format(f="27 * a.d3 * b.d3 + a.d0 * b.d0"), {"dig": _DIGITS}),
    "spectral_dot": build(_DOT.format(where="WHERE a.u // 8 < 4 AND a.u % 8 < 4"), _SPECTRUM),
    "spectral_dot_full": build("SELECT t.qid, t.tid, CAST(64 * sum(a.t * b.t) AS BIGINT) AS dot FROM top t JOIN tern a ON a.id = t.qid JOIN tern b ON b.id = t.tid AND b.pos = a.pos GROUP BY 1, 2"),
    "divergence_variants": build("""SELECT t.qid, t.tid, CAST(-greatest(0, abs(q.ns - c.ns) - 2) - CASE WHEN q.cy >= 0 AND c.cy >= 0 THEN greatest(0, abs(q.cy - c.cy) - 2) * 2 WHEN (q.cy < 0) <> (c.cy < 0) THEN 10 ELSE 0 END AS INT) AS dead,
        CAST(-abs(len(list_filter(b.s, lambda v: q.ns >= v)) - len(list_filter(b.s, lambda v: c.ns >= v))) AS INT) AS bucket FROM top t JOIN neg q ON q.id = t.qid JOIN neg c ON c.id = t.tid, cuts b""",
        {"cuts": "SELECT list_transform(range(7), lambda k: s[(k + 1) * len(s) // 8 + 1]) AS s FROM (SELECT list_sort(list(ns)) AS s FROM neg JOIN img ON img.id = neg.id WHERE NOT q)"}),
    "channel_snr": build("""SELECT channel, round((avg(d) FILTER (WHERE same) - avg(d) FILTER (WHERE NOT same)) / (sqrt(var_pop(d) FILTER (WHERE NOT same)) + 1e-9), 6) AS snr FROM (
        SELECT a.channel, p.id, p.same, CAST(sum(a.t * b.t) AS DOUBLE) AS d FROM prs p JOIN chan a ON a.id = p.id JOIN chan b ON b.id = p.pid AND b.channel = a.channel AND b.y = a.y AND b.x = a.x GROUP BY 1, 2, 3) GROUP BY channel""",
        {"firsts": "SELECT label, coalesce(lead(f) OVER (ORDER BY label), first_value(f) OVER (ORDER BY label)) AS pid FROM (SELECT label, min(id) AS f FROM img WHERE NOT q GROUP BY label)",
         "prs": "SELECT * FROM (SELECT id, lead(id) OVER (PARTITION BY label ORDER BY id) AS pid, true AS same FROM img WHERE NOT q) WHERE pid IS NOT NULL UNION ALL SELECT i.id, f.pid, false FROM img i JOIN firsts f ON f.label = i.label WHERE NOT i.q"}),
    "series_ordered": build(_best("""SELECT stop, qid, label, cls, round(sum(ln(c + 0.5)), 9) AS v FROM cells JOIN ords USING (pos), (VALUES (4), (8), (16)) z(stop) WHERE ord <= stop GROUP BY stop, qid, label, cls""", "stop, qid, label", "stop, qid"),
        _CELLS | {"ords": "SELECT pos, row_number() OVER (ORDER BY raw DESC, pos) AS ord FROM rawig WHERE channel = 'px'"}).replace("SELECT stop, qid, label, arg_max", "SELECT CAST(stop AS INT) AS stop, qid, label, arg_max"),
    "series_product": build(_best(f"SELECT qid, label, cls, round(({_SOFT.format(c='p', t='tp', temp=100)}) * ({_SOFT.format(c='v', t='tv', temp=100)}) * ({_SOFT.format(c='h', t='th', temp=100)}), 12) AS v FROM hw JOIN ct USING (qid)")),
    "series_sequential": build(_best("SELECT qid, label, cls, round(post, 12) AS v FROM s3"), {"s0": "SELECT qid, label, cls, p, h, v, tp, th, tv, 0.1::DOUBLE AS post FROM hw JOIN ct USING (qid)", "s1": _update("s0", "v", 100), "s2": _update("s1", "p", 50), "s3": _update("s2", "h", 25)}),
    "series_interleaved": build(_best(_NB)),
    "naive_bayes_eyes": build(_best("SELECT qid, label, cls, round(sum(v), 9) AS v FROM eyes GROUP BY qid, label, cls"), {"eyes": " UNION ALL ".join(f"SELECT * FROM ({build(_NB.replace('round(sum(ln(coalesce(cnt, 0) + 0.5)), 9)', 'sum(ln(coalesce(cnt, 0) + 0.5))'), e)})" for e in (
        None, {"tern": "SELECT *, CASE WHEN p > 192 THEN 1 WHEN p < 64 THEN -1 ELSE 0 END AS t FROM cell"},
        {"tern": f"SELECT c.*, CASE WHEN c.p > z.hi THEN 1 WHEN c.p < z.lo THEN -1 ELSE 0 END AS t FROM cell c JOIN (SELECT id, {_WIDEN} FROM (SELECT id, s[22] AS a, s[43] AS b FROM (SELECT id, list_sort(list(p)) AS s FROM cell GROUP BY id))) z ON z.id = c.id"}))}),
    "hotmap_multiprobe": build("""SELECT qid, label, arg_max(cls, s * 100 - cls) AS pred, list_sort(list(s), 'DESC')[1] - list_sort(list(s), 'DESC')[2] AS margin FROM (SELECT qid, label, cls, CAST(sum(c) AS BIGINT) AS s FROM (
        SELECT c.qid, c.label, c.cls, c.c * w AS c FROM cells c JOIN ig ON ig.channel = c.channel AND ig.pos = c.pos UNION ALL
        SELECT h.qid, h.label, hot.label, cnt // 4 FROM hotq h JOIN ham USING (val) JOIN hot ON hot.channel = h.channel AND hot.pos = h.pos AND hot.val = ham.nval) GROUP BY qid, label, cls) GROUP BY qid, label""", _CELLS),
    "dual_hot_map": build("""SELECT qid, label, arg_max(cls, a * 100 - cls) AS px, arg_max(cls, b * 100 - cls) AS gm, arg_max(cls, (a + b // 2) * 100 - cls) AS dual FROM (SELECT i.id AS qid, i.label, cls, coalesce(x.v, 0) AS a, coalesce(y.v, 0) AS b FROM img i CROSS JOIN cls
        LEFT JOIN dx x ON x.qid = i.id AND x.cls = cls.cls LEFT JOIN dy y ON y.qid = i.id AND y.cls = cls.cls WHERE i.q) GROUP BY qid, label""".replace("cls, coalesce", "cls.cls AS cls, coalesce"),
        {"sx": "SELECT id, label, q, pos, val FROM sig WHERE channel = 'px' AND val <> 0", "sy": f"SELECT id, label, q, bin AS pos, CAST({_QC} AS INT) AS val FROM gm WHERE n <> 0", "dx": _dual("sx"), "dy": _dual("sy")}),
    "level_fusion": build("SELECT qid, label, arg_max(cls, s * 100 - cls) AS pred FROM (SELECT qid, label, cls, sum(score) AS s FROM lv GROUP BY qid, label, cls) GROUP BY qid, label",
        {"lv": f"SELECT * FROM ({build(_SCORES)}) UNION ALL SELECT qid, label, cls, score * 8 FROM ({build(_SCORES, _COARSE)})"}),
    "nearest_mean": build(_best("SELECT t.id AS qid, t.label, m.label AS cls, round(CAST(sum(t.t * m.s) AS DOUBLE) / max(m.n), 9) AS v FROM tern t JOIN means m ON m.pos = t.pos WHERE t.q GROUP BY 1, 2, 3"), {"means": _MEANS}),
    "nearest_spectrum": build(_best("SELECT a.id AS qid, a.label, p.label AS cls, sum(a.coef * p.m) AS v FROM had a JOIN protos p ON p.u = a.u WHERE a.q GROUP BY 1, 2, 3"),
        _SPECTRUM | {"protos": f"SELECT label, u, {_TRUNC.format('sum(coef)', 'count(*)')} AS m FROM had WHERE NOT q AND u // 8 < 4 AND u % 8 < 4 GROUP BY label, u"}),
    "noisy_prototype": build(_best(f"""SELECT t.id AS qid, t.label, p.label AS cls, sum(CASE WHEN {_HEX.format("'noise-hit-' || t.id || '-' || t.pos", 8)} % 1000 < 200 THEN {_HEX.format("'noise-trit-' || t.id || '-' || t.pos", 8)} % 3 - 1 ELSE t.t END * p.proto) AS v
        FROM tern t JOIN protos p ON p.pos = t.pos WHERE t.q GROUP BY 1, 2, 3"""), {"means": _MEANS, "protos": _PROTO}),
    "vote_random_bags": build(f"""SELECT CAST(b AS INT) AS bag, qid, tid, CAST(sum(w) AS BIGINT) AS votes FROM range(4) r(b), pexact JOIN post USING (channel, pos, val) WHERE channel = 'px' AND {_HEX.format("'bag-' || b || '-' || pos", 4)} % 100 < 70 GROUP BY b, qid, tid"""),
    "vote_scaled": build("""SELECT qid, tid, CAST(sum(w) AS BIGINT) AS votes FROM (SELECT qid, channel, pos, val, CASE WHEN channel = 'hg' THEN w * 50 // 100 ELSE w END AS w FROM pmulti) z JOIN post USING (channel, pos, val) WHERE w > 0 GROUP BY qid, tid"""),
    "first_blocks_vote": build("SELECT qid, tid, votes FROM fbv", _FBV),
    "first_blocks_knn": build(_KNN.format(keys="qid", rows="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dot DESC, votes DESC, tid) AS place FROM fbd) WHERE place <= 3"), _FBV | {
        "fbt": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, tid) AS rank FROM fbv) WHERE rank <= 20",
        "fbd": "SELECT f.qid, f.tid, f.tlabel, f.votes, a.label, sum(a.t * b.t) AS dot FROM fbt f JOIN tern a ON a.id = f.qid JOIN tern b ON b.id = f.tid AND b.pos = a.pos GROUP BY 1, 2, 3, 4, 5"}),
    "soft_prior_tempered": build("""SELECT v.qid, v.tid, CAST(votes * boost AS BIGINT) AS votes FROM votespx v JOIN (SELECT qid, cls, 1 + CAST(floor(round(1.0::DOUBLE * p / sum(p) OVER (PARTITION BY qid) * 16, 6)) AS BIGINT) AS boost FROM (
        SELECT qid, cls, pow(score / greatest(1, sum(score) OVER (PARTITION BY qid))::DOUBLE + 1e-30, 2.0) AS p FROM hsum)) b ON b.qid = v.qid AND b.cls = v.tlabel"""),
    "pair_experts": build("""SELECT k.qid, k.label, coalesce(own, pred) AS pred, own IS NOT NULL AS expert FROM base k LEFT JOIN (SELECT qid, arg_max(tlabel, (coalesce(v, 0) * 100000 + votes) * 1000000 - tid) AS own FROM mine GROUP BY qid) m ON m.qid = k.qid""",
        _JOINT | _PAIRS | {"base": f"SELECT * FROM ({build('SELECT qid, label, pred FROM knn')})", "post0": f"SELECT * FROM ({build(_NB)})",
        "close": "SELECT qid, min(cls) AS a, max(cls) AS b FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v DESC, cls) AS rn FROM post0) WHERE rn <= 2 GROUP BY qid HAVING max(v) - min(v) < 40",
        "mine": """SELECT t.qid, t.tid, t.tlabel, t.votes, h.v FROM top t JOIN close c ON c.qid = t.qid LEFT JOIN hits h ON h.qid = t.qid AND h.tid = t.tid WHERE t.tlabel IN (c.a, c.b)""",
        "hits": """SELECT t.qid, t.tid, sum(g.w) AS v FROM top t JOIN close c ON c.qid = t.qid JOIN sig a ON a.id = t.qid JOIN sig b ON b.id = t.tid AND b.pos = a.pos AND b.val = a.val JOIN bg ON bg.channel = a.channel
            JOIN pairs g ON g.a = c.a AND g.b = c.b AND g.pos = a.pos WHERE a.val <> bg.bg GROUP BY 1, 2"""}),
    "cascade_gauss": build("SELECT CAST(k AS INT) AS k, z.qid, i.label, pred FROM (" + _KNN.format(keys="k, qid", rows="SELECT k, qid, 0 AS label, tlabel FROM near, (VALUES (1), (3), (5), (7)) y(k) WHERE place <= k") + ") z JOIN img i ON i.id = z.qid", _CASCADE),
    "meta_router": build("""SELECT a.qid, a.label, CASE WHEN coalesce(n1, 0) >= coalesce(n2, 0) THEN 'signs' ELSE 'means' END AS system, CASE WHEN coalesce(n1, 0) >= coalesce(n2, 0) THEN a.signs ELSE a.means END AS pred FROM both2 a LEFT JOIN (
        SELECT qid, sum(CAST(b.signs = b.label AS INT)) AS n1, sum(CAST(b.means = b.label AS INT)) AS n2 FROM nn JOIN (SELECT qid AS tid, label, signs, means FROM both2 WHERE NOT q) b USING (tid) GROUP BY qid) w ON w.qid = a.qid WHERE a.q""", {
        "means": _MEANS, "protos": _PROTO, "p1": _best("SELECT t.id AS qid, t.label, p.label AS cls, sum(t.t * p.proto) AS v FROM tern t JOIN protos p ON p.pos = t.pos GROUP BY 1, 2, 3"),
        "p2": _best("SELECT t.id AS qid, t.label, m.label AS cls, round(CAST(sum(t.t * m.s) AS DOUBLE) / max(m.n), 9) AS v FROM tern t JOIN means m ON m.pos = t.pos GROUP BY 1, 2, 3"),
        "both2": "SELECT i.id AS qid, i.label, i.q, p1.pred AS signs, p2.pred AS means FROM img i JOIN p1 ON p1.qid = i.id JOIN p2 ON p2.qid = i.id",
        "nn": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS rank FROM (SELECT a.id AS qid, b.id AS tid, sum(abs(a.n - b.n)) AS d FROM gm a JOIN gm b ON b.bin = a.bin WHERE a.q AND NOT b.q GROUP BY 1, 2)) WHERE rank <= 10"}),
    "gate_sweep": build("""SELECT CAST(percent AS INT) AS percent, threshold, CAST(sum(CAST(gap < threshold AS INT)) AS BIGINT) AS later, CAST(sum(CAST(CASE WHEN gap < threshold THEN k.pred ELSE m.pred END = m.label AS INT)) AS BIGINT) AS correct
        FROM marg m JOIN knn k ON k.qid = m.qid, (SELECT percent, g[least(len(g) * percent // 100, len(g) - 1) + 1] AS threshold FROM (SELECT list_sort(list(gap)) AS g FROM marg), (VALUES (0), (10), (25), (50), (75), (90)) z(percent)) c GROUP BY percent, threshold""", {"marg": _MARGIN}),
    "concentration_sweep": build("""SELECT CAST(t AS INT) AS threshold, count(*) AS n, CAST(sum(CAST(best = label AS INT)) AS BIGINT) AS correct FROM (SELECT qid, arg_max(tlabel, k * 100 - tlabel) AS best, max(k) AS best_n FROM (SELECT qid, tlabel, count(*) AS k FROM top GROUP BY qid, tlabel) GROUP BY qid) c
        JOIN img ON img.id = c.qid, (VALUES (4), (8), (12), (16), (20)) z(t) WHERE best_n >= t GROUP BY t"""),
    "binned_accuracy": build("""SELECT feature, lo, count(*) AS n, CAST(sum(ok) AS BIGINT) AS correct, CAST(sum(1 - ok) AS BIGINT) AS wrong FROM (SELECT feature, list_max(list_filter(e, lambda x: x <= val)) AS lo, ok FROM (
        SELECT unnest(['agree', 'mad', 'votes']) AS feature, unnest([[2, 4, 6, 8], [1, 2, 4, 8], [4, 8, 12, 20]]::BIGINT[][]) AS e, unnest([agree, CAST(mad AS BIGINT), votes]) AS val, CAST(label = pred AS INT) AS ok
        FROM knn JOIN agree USING (qid) JOIN (SELECT qid, max(k) AS votes FROM (SELECT qid, tlabel, count(*) AS k FROM top GROUP BY qid, tlabel) GROUP BY qid) v USING (qid))) GROUP BY feature, lo"""),
    "composite_errors": build("""SELECT predicate, count(*) AS n, CAST(sum(bad) AS BIGINT) AS wrong FROM (SELECT unnest(['few', 'wide', 'close', 'few and close']) AS predicate, unnest([agree <= 4, mad >= 3, gap < 1000, agree <= 4 AND gap < 1000]) AS ok, CAST(label <> pred AS INT) AS bad
        FROM knn JOIN agree USING (qid)) WHERE ok GROUP BY predicate"""),
    "scaled_sweep": build("""SELECT CAST(cut AS INT) AS cut, CAST(k AS INT) AS k, CAST(alpha AS INT) AS alpha, count(*) AS n, CAST(sum(CAST(pred = label AS INT)) AS BIGINT) AS correct FROM (""" + _KNN.format(keys="cut, k, alpha, qid", rows="""SELECT cut, k, alpha, qid, label, tlabel FROM swr,
        (VALUES (10, 1), (10, 3), (40, 1), (40, 3)) z(cut, k) WHERE rank <= cut AND rank <= k""") + ") GROUP BY cut, k, alpha", {
        "chv": "SELECT qid, tid, tlabel, channel, sum(w) AS v FROM pexact JOIN post USING (channel, pos, val) GROUP BY qid, tid, tlabel, channel",
        "swv": "SELECT alpha, qid, tid, tlabel, sum(CASE WHEN channel = 'hg' THEN v * alpha // 100 ELSE v END) AS votes FROM chv, (VALUES (0), (50), (100)) a(alpha) GROUP BY alpha, qid, tid, tlabel",
        "swr": "SELECT s.*, i.label, row_number() OVER (PARTITION BY alpha, qid ORDER BY votes DESC, tid) AS rank FROM swv s JOIN img i ON i.id = s.qid WHERE votes > 0"}),
    "baseline_knn_l2": build(_KNN.format(keys="qid", rows="""SELECT qid, label, tlabel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS rank FROM (SELECT a.id AS qid, a.label, b.id AS tid, b.label AS tlabel, sum((a.p - b.p) * (a.p - b.p)) AS d
        FROM cell a JOIN cell b ON b.pos = a.pos WHERE a.q AND NOT b.q GROUP BY 1, 2, 3, 4)) WHERE rank <= 3""")),
    "noise_coding": f"""SELECT CAST(level AS INT) AS level, sigma, count(*) AS n, CAST(sum(CAST(got = sent AS INT)) AS BIGINT) AS correct, CAST(sum(abs(got - sent)) AS BIGINT) AS far FROM (
        SELECT level, sigma, sent, greatest(-level, least(level, CAST(round_even(round((CAST(sent AS DOUBLE) / level + g * sigma) * level, 9), 0) AS INT))) AS got FROM (
        SELECT level, sigma, CAST(v % (2 * level + 1) - level AS INT) AS sent, g FROM (SELECT sqrt(-2 * ln(({_HEX.format("'code-a-' || id", 8)} + 0.5::DOUBLE) / 4294967296.0)) * cos(2 * pi() * (({_HEX.format("'code-b-' || id", 8)} + 0.5::DOUBLE) / 4294967296.0)) AS g,
        {_HEX.format("'code-v-' || id", 8)} AS v FROM range(20000) r(id)), (VALUES (1), (13), (40)) a(level), (VALUES (0.02::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE)) b(sigma))) GROUP BY level, sigma""",
    "search_static": build("SELECT * FROM found", _STATIC),
    "search_best": build("SELECT * FROM found ORDER BY correct DESC, grid, cent, prof, div, gdiv, scale LIMIT 1", _STATIC),
    "search_bayes": build("""SELECT CAST(ds AS INT) AS decay, CAST(ks AS INT) AS "first", CAST(tw AS INT) AS topo, count(*) AS n, CAST(sum(CAST(label = pred AS INT)) AS BIGINT) AS correct FROM (
        SELECT ds, ks, tw, qid, label, arg_max(cls, s * 100 - cls) AS pred FROM (SELECT ds, ks, tw, qid, label, cls, sum(CASE WHEN tlabel = cls THEN ev ELSE 0 END) AS s FROM (
        SELECT ds, ks, tw, qid, label, tlabel, """ + _TRUNC.format("(combined + tw * (div_sim + gdiv_sim)) * ds", "ds + place - 1") + """ AS ev FROM (SELECT * FROM ranked WHERE qid < 250) r, (VALUES (1), (2), (3), (5), (10), (20), (50)) a(ds),
        (VALUES (3), (5), (7), (10), (15), (20), (50)) b(ks), (VALUES (0), (50), (100), (200)) c(tw) WHERE place <= ks) CROSS JOIN cls GROUP BY ALL) GROUP BY ALL) GROUP BY ds, ks, tw"""),
}
