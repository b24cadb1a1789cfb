"""SQL of the queries, for an independent engine: named parts that are put together as needed."""

from __future__ import annotations

import re

K = 40

#: Named parts; a part may use others by name. Integers are cast, since sums may be wider than here.
PARTS: dict[str, str] = {
    "img": "SELECT vec_id AS id, label, vec_id % 5 = 0 AS q, embedding AS e FROM embeddings",
    "cell": """SELECT id, label, q, CAST(i AS INT) AS pos, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
        greatest(0, least(255, CAST(floor(CAST(e[i + 1] AS DOUBLE) * 768 + 128) AS INT))) AS p FROM img, range(64) r(i)""",
    "tern": "SELECT *, CASE WHEN p > 170 THEN 1 WHEN p < 85 THEN -1 ELSE 0 END AS t FROM cell",
    "stepped": """SELECT *, CASE WHEN x = 7 THEN 0 ELSE lead(p) OVER (PARTITION BY id, y ORDER BY x) - p END AS gx,
        CASE WHEN y = 7 THEN 0 ELSE lead(p) OVER (PARTITION BY id, x ORDER BY y) - p END AS gy FROM cell""",
    "grad": """SELECT *, CASE WHEN x = 7 THEN 0 ELSE greatest(-1, least(1, lead(t) OVER (PARTITION BY id, y ORDER BY x) - t)) END AS hg,
        CASE WHEN y = 7 THEN 0 ELSE greatest(-1, least(1, lead(t) OVER (PARTITION BY id, x ORDER BY y) - t)) END AS vg FROM tern""",
    "chan": "SELECT id, label, q, 'px' AS channel, y, x, t FROM grad UNION ALL SELECT id, label, q, 'hg', y, x, hg FROM grad UNION ALL SELECT id, label, q, 'vg', y, x, vg FROM grad",
    "sig": """SELECT id, label, q, channel, CAST(y * 2 + x // 3 AS INT) AS pos,
        CAST(sum((t + 1) * CASE x % 3 WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 1 END) AS INT) AS val
        FROM chan WHERE x < 6 GROUP BY id, label, q, channel, y, x // 3""",
    "wide": """SELECT id, label, q, pos, pos // 2 AS y, pos % 2 AS s, max(CASE WHEN channel = 'px' THEN val END) AS a,
        max(CASE WHEN channel = 'hg' THEN val END) AS b, max(CASE WHEN channel = 'vg' THEN val END) AS c FROM sig GROUP BY id, label, q, pos""",
    "turned": """SELECT *, lag(a) OVER (PARTITION BY id, y ORDER BY s) AS left_, lag(a) OVER (PARTITION BY id, s ORDER BY y) AS up,
        lead(a) OVER (PARTITION BY id, y ORDER BY s) AS right_, lead(a) OVER (PARTITION BY id, s ORDER BY y) AS down FROM wide""",
    "bg": "SELECT channel, arg_max(val, n * 1000 - val) AS bg FROM (SELECT channel, val, count(*) AS n FROM sig WHERE NOT q GROUP BY channel, val) GROUP BY channel",
    "hot": "SELECT channel, pos, val, label, count(*) AS cnt FROM sig WHERE NOT q GROUP BY channel, pos, val, label",
    "prior": """SELECT channel, pos, sum(-n / tot * log2(n / tot)) AS hc, CAST(sum(n) AS DOUBLE) AS tot FROM (
        SELECT channel, pos, label, CAST(sum(cnt) AS DOUBLE) AS n, CAST(sum(sum(cnt)) OVER (PARTITION BY channel, pos) AS DOUBLE) AS tot
        FROM hot GROUP BY channel, pos, label) GROUP BY channel, pos""",
    "cond": """SELECT channel, pos, val, -cnt * log2(cnt / CAST(sum(cnt) OVER (PARTITION BY channel, pos, val) AS DOUBLE)) AS e FROM hot""",
    "rawig": """SELECT channel, pos, round(hc - he / tot, 9) AS raw FROM prior JOIN (
        SELECT channel, pos, sum(CASE WHEN val = bg THEN 0.0 ELSE e END) AS he FROM cond JOIN bg USING (channel) GROUP BY channel, pos) USING (channel, pos)""",
    "ig": """SELECT channel, pos, CASE WHEN most > 0 THEN greatest(1, CAST(floor(round(raw / most * 16, 6) + 0.5) AS INT)) ELSE 1 END AS w
        FROM (SELECT *, max(raw) OVER (PARTITION BY channel) AS most FROM rawig)""",
    "code": "SELECT CAST(v AS INT) AS val FROM range(27) r(v)",
    "adj": """SELECT a.val, b.val AS nval FROM code a, code b
        WHERE abs(a.val // 9 - b.val // 9) + abs(a.val // 3 % 3 - b.val // 3 % 3) + abs(a.val % 3 - b.val % 3) = 1""",
    "ham": """SELECT a.val, b.val AS nval FROM code a, code b
        WHERE CAST(a.val // 9 <> b.val // 9 AS INT) + CAST(a.val // 3 % 3 <> b.val // 3 % 3 AS INT) + CAST(a.val % 3 <> b.val % 3 AS INT) = 1""",
    "qsig": "SELECT id AS qid, label, channel, pos, val, w, bg FROM sig JOIN ig USING (channel, pos) JOIN bg USING (channel) WHERE q AND val <> bg",
    "post": "SELECT channel, pos, val, id AS tid, label AS tlabel FROM sig JOIN bg USING (channel) WHERE NOT q AND val <> bg",
    "postall": "SELECT channel, pos, val, id AS tid, label AS tlabel FROM sig WHERE NOT q",
    "near": "SELECT qid, channel, pos, nval AS val, CASE WHEN w > 1 THEN w // 2 ELSE 1 END AS w FROM qsig JOIN adj USING (val) WHERE nval <> bg",
    "nearham": "SELECT qid, channel, pos, nval AS val, w // 2 AS w FROM qsig JOIN ham USING (val) WHERE w > 1",
    "pexact": "SELECT qid, channel, pos, val, w FROM qsig",
    "pmulti": "SELECT * FROM pexact UNION ALL SELECT * FROM near",
    "votes3": "SELECT qid, tid, tlabel, CAST(sum(w) AS BIGINT) AS votes FROM pmulti JOIN post USING (channel, pos, val) GROUP BY qid, tid, tlabel",
    "votespx": "SELECT qid, tid, tlabel, CAST(sum(w) AS BIGINT) AS votes FROM pexact JOIN post USING (channel, pos, val) WHERE channel = 'px' GROUP BY qid, tid, tlabel",
    "votesvg": "SELECT qid, tid, tlabel, CAST(sum(w) AS BIGINT) AS votes FROM pexact JOIN post USING (channel, pos, val) WHERE channel = 'vg' GROUP BY qid, tid, tlabel",
    "top": f"SELECT qid, tid, tlabel, votes, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, tid) AS rank FROM votes3) WHERE rank <= {K}",
    "toppx": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, tid) AS rank FROM votespx) WHERE rank <= 20",
    "topvg": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, tid) AS rank FROM votesvg) WHERE rank <= 20",
    "dcell": """SELECT *, hg - coalesce(lag(hg) OVER (PARTITION BY id, y ORDER BY x), 0) + vg - coalesce(lag(vg) OVER (PARTITION BY id, x ORDER BY y), 0) AS d FROM grad""",
    "neg": """SELECT id, CAST(coalesce(sum(CASE WHEN d < 0 THEN d END), 0) AS INT) AS ns,
        CAST(coalesce(sum(CASE WHEN d < 0 THEN y END) // nullif(count(CASE WHEN d < 0 THEN 1 END), 0), -1) AS INT) AS cy FROM dcell GROUP BY id""",
    "gdiv": "SELECT id, CAST(y * 2 // 8 * 4 + x * 4 // 8 AS INT) AS region, CAST(sum(CASE WHEN d < 0 THEN d ELSE 0 END) AS INT) AS s FROM dcell GROUP BY id, 2",
    "prof": "SELECT id, y, CAST(sum(CASE WHEN t > 0 THEN 1 ELSE 0 END) AS INT) AS n FROM tern GROUP BY id, y",
    # Cells from -1 to 8: what is reached from outside through cells without foreground.
    "padded": """SELECT i.id, CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x, coalesce(t.t, 0) > 0 AS fg FROM img i, range(-1, 9) a(y), range(-1, 9) b(x) LEFT JOIN tern t ON t.id = i.id AND t.y = a.y AND t.x = b.x""",
    "free": "SELECT id, y, x FROM padded WHERE NOT fg",
    "reach": """SELECT id, y, x FROM free WHERE y IN (-1, 8) OR x IN (-1, 8)
        UNION SELECT f.id, f.y, f.x FROM reach r JOIN free f ON f.id = r.id AND abs(f.y - r.y) + abs(f.x - r.x) = 1""",
    "cent": """SELECT i.id, CAST(coalesce(c.v, -1) AS INT) AS cent FROM img i LEFT JOIN (
        SELECT id, sum(y) // count(*) AS v FROM (SELECT id, y, x FROM free WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 EXCEPT SELECT id, y, x FROM reach) GROUP BY id) c ON c.id = i.id""",
    "described": "SELECT i.id, i.label, ns, cy, cent FROM img i JOIN neg ON neg.id = i.id JOIN cent ON cent.id = i.id",
    "celldot": """SELECT qid, tid, CAST(sum(a.t * b.t) AS BIGINT) AS dot_px, CAST(sum(a.vg * b.vg) AS BIGINT) AS dot_vg, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS sad
        FROM {top} JOIN grad a ON a.id = qid JOIN grad b ON b.id = tid AND b.pos = a.pos GROUP BY qid, tid""",
    "profdot": "SELECT qid, tid, CAST(sum(a.n * b.n) AS BIGINT) AS prof_sim FROM {top} JOIN prof a ON a.id = qid JOIN prof b ON b.id = tid AND b.y = a.y GROUP BY qid, tid",
    "gdist": "SELECT qid, tid, CAST(-sum(abs(a.s - b.s)) AS BIGINT) AS gdiv_sim FROM {top} JOIN gdiv a ON a.id = qid JOIN gdiv b ON b.id = tid AND b.region = a.region GROUP BY qid, tid",
    "feat": """SELECT t.qid, t.tid, t.tlabel, q.label, t.votes, t.rank, dot_px, dot_vg, sad, prof_sim, gdiv_sim, c.ns, q.ns AS q_ns, c.cent, q.cent AS q_cent,
        CAST(CASE WHEN q.cent < 0 AND c.cent < 0 THEN 50 WHEN q.cent < 0 OR c.cent < 0 THEN -80 ELSE -abs(q.cent - c.cent) END AS BIGINT) AS cent_sim,
        CAST(-abs(q.ns - c.ns) - CASE WHEN q.cy >= 0 AND c.cy >= 0 THEN 2 * abs(q.cy - c.cy) WHEN (q.cy < 0) <> (c.cy < 0) THEN {one_sided} ELSE 0 END AS BIGINT) AS div_sim
        FROM {top} t JOIN celldot USING (qid, tid) JOIN profdot USING (qid, tid) JOIN gdist USING (qid, tid) JOIN described q ON q.id = t.qid JOIN described c ON c.id = t.tid""",
    "madv": """SELECT qid, CAST(CASE WHEN len(v) < 3 THEN 1000 ELSE greatest(1, list_sort(list_transform(v, lambda x: abs(x - v[len(v) // 2 + 1])))[len(v) // 2 + 1]) END AS INT) AS mad
        FROM (SELECT qid, list_sort(list(ns)) AS v FROM feat GROUP BY qid)""",
    "scored": """SELECT *, CAST(256 * dot_px + 192 * dot_vg + (2500 // (50 + mad)) * cent_sim + (800 // (50 + mad)) * prof_sim
        + (10000 // (50 + mad)) * div_sim + (5000 // (50 + mad)) * gdiv_sim AS BIGINT) AS combined FROM feat JOIN madv USING (qid)""",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY combined DESC, votes DESC, tid) AS INT) AS place FROM scored",
    "knn": "SELECT qid, label, arg_max(tlabel, n * 100 - tlabel) AS pred FROM (SELECT qid, label, tlabel, count(*) AS n FROM ranked WHERE place <= 3 GROUP BY qid, label, tlabel) GROUP BY qid, label",
    "cls": "SELECT CAST(c AS INT) AS cls FROM range(10) r(c)",
    "hotq": "SELECT id AS qid, label, channel, pos, val FROM sig JOIN bg USING (channel) WHERE q AND val <> bg",
    "hs": """SELECT h.qid, h.label, h.channel, cls, CAST(sum(coalesce(cnt, 0)) AS BIGINT) AS score FROM hotq h CROSS JOIN cls
        LEFT JOIN hot ON hot.channel = h.channel AND hot.pos = h.pos AND hot.val = h.val AND hot.label = cls GROUP BY h.qid, h.label, h.channel, cls""",
    "hsum": "SELECT qid, label, cls, CAST(sum(score) AS BIGINT) AS score FROM hs GROUP BY qid, label, cls",
    "hotpred": "SELECT qid, label, arg_max(cls, score * 100 - cls) AS pred FROM hsum GROUP BY qid, label",
    "hw": "SELECT qid, label, cls, max(CASE WHEN channel = 'px' THEN score END) AS p, max(CASE WHEN channel = 'hg' THEN score END) AS h, max(CASE WHEN channel = 'vg' THEN score END) AS v FROM hs GROUP BY qid, label, cls",
    "chtop": """SELECT qid, channel, arg_max(cls, score * 100 - cls) AS best, max(score) AS top, list_sort(list(score), 'DESC')[1] - list_sort(list(score), 'DESC')[2] AS gap FROM hs GROUP BY qid, channel""",
    "ct": """SELECT qid, max(CASE WHEN channel = 'px' THEN best END) AS bp, max(CASE WHEN channel = 'hg' THEN best END) AS bh, max(CASE WHEN channel = 'vg' THEN best END) AS bv,
        max(CASE WHEN channel = 'px' THEN gap END) AS mp, max(CASE WHEN channel = 'hg' THEN gap END) AS mh, max(CASE WHEN channel = 'vg' THEN gap END) AS mv,
        max(CASE WHEN channel = 'px' THEN top END) AS tp, max(CASE WHEN channel = 'hg' THEN top END) AS th, max(CASE WHEN channel = 'vg' THEN top END) AS tv FROM chtop GROUP BY qid""",
    "gm": """SELECT g.id, g.label, g.q, CAST(b AS INT) AS bin, CAST(sum(CASE WHEN (hg + 1) * 15 + (vg + 1) * 5 + greatest(-2, least(2, d)) + 2 = b THEN 1 ELSE 0 END) AS BIGINT) AS n
        FROM dcell g, range(45) r(b) GROUP BY g.id, g.label, g.q, b""",
    "ground": """SELECT label, bin, m AS mean, CASE WHEN v <= 0 THEN 1 ELSE greatest(1, CAST(floor(sqrt(CAST(v AS DOUBLE))) AS INT)) END AS dev FROM (
        SELECT label, bin, CAST(sum(n) // count(*) AS BIGINT) AS m, CAST(sum(n * n) // count(*) AS BIGINT) - CAST(sum(n) // count(*) AS BIGINT) * CAST(sum(n) // count(*) AS BIGINT) AS v
        FROM gm WHERE NOT q GROUP BY label, bin)""",
    "agree": """SELECT qid, CAST(sum(CASE WHEN tlabel = first THEN 1 ELSE 0 END) AS BIGINT) AS agree, max(CASE WHEN place = 1 THEN combined END) - coalesce(max(CASE WHEN place = 2 THEN combined END), max(CASE WHEN place = 1 THEN combined END)) AS gap, max(mad) AS mad
        FROM (SELECT *, max(CASE WHEN place = 1 THEN tlabel END) OVER (PARTITION BY qid) AS first FROM ranked WHERE place <= 10) GROUP BY qid""",
    "cmap": """SELECT CAST(qid % 2 AS INT) AS fold, agree, CAST(mad >= 2 AS INT) + CAST(mad >= 4 AS INT) + CAST(mad >= 6 AS INT) AS mad_bucket,
        CAST(gap >= 500 AS INT) + CAST(gap >= 1500 AS INT) + CAST(gap >= 3000 AS INT) AS gap_bucket, count(*) AS n, CAST(sum(CAST(label = pred AS INT)) AS BIGINT) AS correct
        FROM knn JOIN agree USING (qid) GROUP BY 1, 2, 3, 4""",
    "bagv": """SELECT CAST(b AS INT) AS bag, qid, tid, tlabel, CAST(sum(w) AS BIGINT) AS votes FROM range(4) r(b), pexact JOIN post USING (channel, pos, val)
        WHERE channel = 'px' AND pos % 4 <> b GROUP BY b, qid, tid, tlabel""",
    "joint": """SELECT id, label, q, pos, CAST((CASE WHEN sa < 0 THEN 0 WHEN sa = 0 THEN 1 WHEN sa < 3 THEN 2 ELSE 3 END) | ((CASE WHEN sb < 0 THEN 0 WHEN sb = 0 THEN 1 WHEN sb < 3 THEN 2 ELSE 3 END) << 2)
        | ((CASE WHEN sc < 0 THEN 0 WHEN sc = 0 THEN 1 WHEN sc < 3 THEN 2 ELSE 3 END) << 4) | (CAST(tl AS INT) << 6) | (CAST(tu AS INT) << 7) AS INT) AS val FROM trit3""",
    "trit3": """SELECT id, label, q, pos, a, b, c, a // 9 + a // 3 % 3 + a % 3 - 3 AS sa, b // 9 + b // 3 % 3 + b % 3 - 3 AS sb, c // 9 + c // 3 % 3 + c % 3 - 3 AS sc,
        coalesce(left_ <> a, false) AS tl, coalesce(up <> a, false) AS tu FROM turned""",
}


def build(final: str, start: dict[str, str] | None = None, **fill: str) -> str:
    """`final` after the parts that it and they name, in order; `start` replaces parts, `fill` fills their blanks."""
    parts = PARTS | (start or {})
    fill = {"top": "top", "one_sided": "10"} | fill
    filled = {k: re.sub(r"\{(\w+)\}", lambda m: fill[m[1]], v) for k, v in parts.items()}
    order: list[str] = []
    open_: set[str] = set()

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"(?:\bFROM|\bJOIN|,)\s+(\w+)", text)):
            if name in filled and name not in order and name not in open_:
                open_.add(name)
                need(filled[name])
                order.append(name)

    need(final)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({filled[n]})" for n in order) + " " + final if order else final


def _trans(a: str, b: str) -> str:
    d = " + ".join(f"{w} * (greatest(-1, least(1, {b} // {w} % 3 - {a} // {w} % 3)) + 1)" for w in (9, 3, 1))
    return f"CAST({d} AS INT)"


def _quant(expr: str, source: str = "cell") -> str:
    return build(f"SELECT id, pos, CAST({expr} AS INT) AS v FROM {source}")


def _bounds(lo: str, hi: str, extra: str = "", vals: str = "list(p)") -> str:
    """Ternary by bounds computed from each image's sorted values `s`."""
    return build(f"""SELECT c.id, c.pos, CASE WHEN p > hi THEN 1 WHEN p < lo THEN -1 ELSE 0 END AS v FROM cell c JOIN (
        SELECT id, {lo} AS lo, {hi} AS hi FROM (SELECT id, {extra or 'a, b'} FROM (SELECT id, s[64 // 3 + 1] AS a, s[128 // 3 + 1] AS b, s FROM (SELECT id, list_sort({vals}) AS s FROM cell GROUP BY id)))) t ON t.id = c.id""")


_STEP = "abs(gx) + abs(gy)"
ORACLE_SQL: dict[str, str] = {
    "quantize_ternary": _quant("CASE WHEN p > 170 THEN 1 WHEN p < 85 THEN -1 ELSE 0 END"),
    "quantize_thresholds": _quant("CASE WHEN p > 192 THEN 1 WHEN p < 64 THEN -1 ELSE 0 END"),
    "quantize_percentile": _bounds("CASE WHEN a = b THEN greatest(a - 1, 0) ELSE a END", "CASE WHEN a = b THEN least(b + 1, 255) ELSE b END"),
    "quantize_percentile_wide": _bounds("CASE WHEN a = b THEN greatest(a - 1, 0) ELSE a END", "CASE WHEN a = b THEN least(b + 1, 255) ELSE b END", "s[64 * 2 // 5 + 1] AS a, s[64 * 9 // 10 + 1] AS b"),
    "quantize_hist_percentile": _bounds("a", "CASE WHEN b <= a THEN a + 1 ELSE b END", "s[64 * 33 // 100 + 1] AS a, s[64 * 67 // 100 + 1] AS b"),
    "quantize_median": _bounds("a", "a", "s[33] AS a, 0 AS b"),
    "quantize_binary": _quant("CASE WHEN p >= 128 THEN 1 ELSE -1 END"),
    "quantize_edge_mask": _quant(f"CASE WHEN {_STEP} < 30 THEN 0 WHEN p > 170 THEN 1 WHEN p < 85 THEN -1 ELSE 0 END", "stepped"),
    "quantize_gradient_direction": _quant(
        f"CASE WHEN {_STEP} < 20 THEN 0 WHEN abs(gx) > 2 * abs(gy) THEN CASE WHEN gx > 0 THEN 1 ELSE -1 END WHEN abs(gy) > 2 * abs(gx) THEN CASE WHEN gy > 0 THEN 1 ELSE -1 END WHEN (gx > 0) = (gy > 0) THEN 1 ELSE -1 END", "stepped"
    ),
    "quantize_gradient_magnitude": build(f"""SELECT c.id, c.pos, CASE WHEN m > hi THEN 1 WHEN m < lo THEN -1 ELSE 0 END AS v FROM (SELECT id, pos, least(255, {_STEP}) AS m FROM stepped) c JOIN (
        SELECT id, CASE WHEN a = b THEN greatest(a - 1, 0) ELSE a END AS lo, CASE WHEN a = b THEN least(b + 1, 255) ELSE b END AS hi FROM (
        SELECT id, s[22] AS a, s[43] AS b FROM (SELECT id, list_sort(list(least(255, {_STEP}))) AS s FROM stepped GROUP BY id))) t ON t.id = c.id"""),
    "quantize_local_contrast": build("""SELECT id, pos, CASE WHEN p - m > 15 THEN 1 WHEN p - m < -15 THEN -1 ELSE 0 END AS v FROM (
        SELECT a.id, a.pos, a.p, sum(b.p) // count(*) AS m FROM cell a JOIN cell b ON b.id = a.id AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2 GROUP BY a.id, a.pos, a.p)"""),
    "quantize_pentary": _quant("CASE WHEN p >= 224 THEN 2 WHEN p >= 192 THEN 1 WHEN p >= 128 THEN 0 WHEN p >= 64 THEN -1 ELSE -2 END"),
    "quantize_pentary_adaptive": build("""SELECT c.id, c.pos, CASE WHEN p > s[52] THEN 2 WHEN p > s[39] THEN 1 WHEN p > s[26] THEN 0 WHEN p > s[13] THEN -1 ELSE -2 END AS v
        FROM cell c JOIN (SELECT id, list_sort(list(p)) AS s FROM cell GROUP BY id) t ON t.id = c.id"""),
    "quantize_balanced_digits": build("SELECT id, pos, CAST(b // 27 - 1 AS INT) AS d3, CAST(b // 9 % 3 - 1 AS INT) AS d2, CAST(b // 3 % 3 - 1 AS INT) AS d1, CAST(b % 3 - 1 AS INT) AS d0 FROM (SELECT id, pos, p * 81 // 256 AS b FROM cell) z"),
    "translate": build("SELECT id, pos, CASE WHEN x = 0 OR y = 0 THEN 0 ELSE lag(p, 9) OVER (PARTITION BY id ORDER BY pos) END AS v FROM cell"),
    "upsample": build("SELECT id, CAST((y * 2 + dy) * 16 + x * 2 + dx AS INT) AS pos, p AS v FROM cell, range(2) u(dy), range(2) v(dx)"),
    "pool_mean": build("SELECT id, CAST(y // 4 * 2 + x // 4 AS INT) AS pos, CAST(sum(p) // 16 AS INT) AS v FROM cell GROUP BY id, y // 4, x // 4"),
    "downsample_rounded": build("SELECT id, CAST(y // 2 * 4 + x // 2 AS INT) AS pos, CAST((sum(p) + 2) // 4 AS INT) AS v FROM cell GROUP BY id, y // 2, x // 2"),
    "gradients": build("SELECT id, pos, hg, vg FROM grad"),
    "pentary_gradients": build("""SELECT id, pos, CASE WHEN x = 7 THEN 0 ELSE greatest(-2, least(2, lead(t) OVER (PARTITION BY id, y ORDER BY x) - t)) END AS hg,
        CASE WHEN y = 7 THEN 0 ELSE greatest(-2, least(2, lead(t) OVER (PARTITION BY id, x ORDER BY y) - t)) END AS vg FROM (
        SELECT *, CASE WHEN p >= 224 THEN 2 WHEN p >= 192 THEN 1 WHEN p >= 128 THEN 0 WHEN p >= 64 THEN -1 ELSE -2 END AS t FROM cell)"""),
    "fixed_splits": build("SELECT CASE WHEN id < 250 THEN 'validation' ELSE 'holdout' END AS part, CAST(id % 2 AS INT) AS fold, label, count(*) AS n FROM img WHERE q GROUP BY 1, 2, 3"),
    "block_signatures": build("SELECT id, channel, pos, val FROM sig"),
    "transition_signatures": build(f"""SELECT id, 'ht' AS channel, CAST(y AS INT) AS pos, {_trans('a', 'right_')} AS val FROM turned WHERE right_ IS NOT NULL
        UNION ALL SELECT id, 'vt', pos, {_trans('a', 'down')} FROM turned WHERE down IS NOT NULL"""),
    "joint_byte": build("SELECT id, pos, val FROM joint"),
    "joint_byte_b": build("""SELECT id, pos, CAST((sign(sa) + 1)::INT | ((sign(sb) + 1)::INT << 2) | ((sign(sc) + 1)::INT << 4) | (CAST(tl AS INT) << 6) | (CAST(tu AS INT) << 7) AS INT) AS val
        FROM (SELECT id, pos, sa, sb, sc, tl, tu FROM trit3)""").replace("(sign(sa) + 1)::INT", "(CASE WHEN sa < 0 THEN 0 WHEN sa = 0 THEN 1 ELSE 2 END)").replace("(sign(sb) + 1)::INT", "(CASE WHEN sb < 0 THEN 0 WHEN sb = 0 THEN 1 ELSE 2 END)").replace("(sign(sc) + 1)::INT", "(CASE WHEN sc < 0 THEN 0 WHEN sc = 0 THEN 1 ELSE 2 END)"),
    "joint_byte_c": build("SELECT id, pos, CAST(((a // 9 * 9 + b // 9 * 3 + c // 9)::INT | ((a::INT & 7) << 5)) & 255 AS INT) AS val FROM wide"),
    "pentary_signatures": build("""SELECT id, CAST(y * 2 + x // 3 AS INT) AS pos, CAST(sum((CASE WHEN p >= 224 THEN 4 WHEN p >= 192 THEN 3 WHEN p >= 128 THEN 2 WHEN p >= 64 THEN 1 ELSE 0 END)
        * CASE x % 3 WHEN 0 THEN 25 WHEN 1 THEN 5 ELSE 1 END) AS INT) AS val FROM cell WHERE x < 6 GROUP BY id, y, x // 3"""),
    "nbr_adjacent": build("SELECT val, nval FROM adj"),
    "nbr_hamming1": build("SELECT val, nval FROM ham"),
    "nbr_bitflip": "SELECT CAST(a AS INT) AS val, CAST(xor(a, 1 << b) AS INT) AS nval FROM range(256) r(a), range(8) s(b)",
    "nbr_pentary": """SELECT CAST(a AS INT) AS val, CAST(b AS INT) AS nval FROM range(125) r(a), range(125) s(b)
        WHERE abs(a // 25 - b // 25) + abs(a // 5 % 5 - b // 5 % 5) + abs(a % 5 - b % 5) = 1""",
    "count_bin_signatures": build("SELECT id, bin AS pos, CAST(CASE WHEN n <= 2 THEN n WHEN n <= 4 THEN 3 WHEN n <= 8 THEN 4 WHEN n <= 16 THEN 5 ELSE 6 END AS INT) AS val FROM gm"),
    "walsh_hadamard": build("SELECT id, CAST(u AS INT) AS u, CAST(sum(CASE WHEN bit_count((pos & u)::INT) % 2 = 1 THEN -t ELSE t END) AS BIGINT) AS coef FROM tern, range(64) r(u) GROUP BY id, u"),
    "background_mode": build("SELECT channel, bg FROM bg"),
    "hot_map": build("SELECT channel, pos, val, label, cnt FROM hot"),
    "info_gain": build("SELECT channel, pos, w FROM ig"),
    "info_gain_all_values": build("""SELECT channel, pos, CASE WHEN most > 0 THEN greatest(1, CAST(floor(round(raw / most * 16, 6) + 0.5) AS INT)) ELSE 1 END AS w FROM (
        SELECT *, max(raw) OVER (PARTITION BY channel) AS most FROM (SELECT channel, pos, round(hc - he / tot, 9) AS raw FROM prior JOIN (SELECT channel, pos, sum(e) AS he FROM cond GROUP BY channel, pos) x USING (channel, pos)))"""),
    "pair_info_gain": build("""SELECT a, b, channel, pos, CASE WHEN most > 0 THEN greatest(1, CAST(floor(round(raw / most * 16, 6) + 0.5) AS INT)) ELSE 1 END AS w FROM (
        SELECT *, max(raw) OVER (PARTITION BY a, b, channel) AS most FROM (
        SELECT a, b, channel, pos, round(hc - he / tot, 9) AS raw FROM (
          SELECT a, b, channel, pos, sum(-n / tot * log2(n / tot)) AS hc, sum(n) AS tot FROM (
            SELECT a, b, channel, pos, label, CAST(sum(cnt) AS DOUBLE) AS n, CAST(sum(sum(cnt)) OVER (PARTITION BY a, b, channel, pos) AS DOUBLE) AS tot FROM two GROUP BY a, b, channel, pos, label) GROUP BY a, b, channel, pos) x
        JOIN (SELECT a, b, channel, pos, sum(CASE WHEN val = bg THEN 0.0 ELSE e END) AS he FROM (
            SELECT *, -cnt * log2(cnt / CAST(sum(cnt) OVER (PARTITION BY a, b, channel, pos, val) AS DOUBLE)) AS e FROM two) JOIN bg4 USING (channel) GROUP BY a, b, channel, pos) y USING (a, b, channel, pos)))""",
        {"two": "SELECT r.a::INT AS a, s.b::INT AS b, channel, pos, val, label, cnt FROM range(10) r(a), range(10) s(b), hot WHERE r.a < s.b AND label IN (r.a, s.b)",
         "bg4": "SELECT channel, arg_max(val, n * 1000 - val) AS bg FROM (SELECT channel, val, count(*) AS n FROM sig WHERE NOT q GROUP BY channel, val) GROUP BY channel"}),
    "channel_gain": build("SELECT channel, round(sum(raw), 6) AS total FROM rawig GROUP BY channel"),
    "postings_stats": build("SELECT channel, pos, val, count(*) AS n, min(tid) AS first_id, max(tid) AS last_id FROM post GROUP BY channel, pos, val"),
    "weighted_cube": build("SELECT channel, pos, val, label, CAST(cnt * w AS BIGINT) AS weighted FROM hot JOIN ig USING (channel, pos)"),
    "class_centroids": build("""SELECT label, pos, s, CASE WHEN s > n // 3 THEN 1 WHEN s < -(n // 3) THEN -1 ELSE 0 END AS proto, CAST(CASE WHEN s < 0 THEN -(-s // n) ELSE s // n END AS INT) AS mean
        FROM (SELECT label, pos, CAST(sum(t) AS BIGINT) AS s, count(*) AS n FROM tern WHERE NOT q GROUP BY label, pos)"""),
    "ground_states": build("SELECT label, bin, mean, dev FROM ground"),
    "delta_map": build("""SELECT g.label AS proto, h.bin, CASE WHEN h.n - g.mean > g.dev THEN 1 WHEN h.n - g.mean < -g.dev THEN -1 ELSE 0 END AS trit, h.label, count(*) AS cnt
        FROM gm h JOIN ground g ON g.bin = h.bin WHERE NOT h.q GROUP BY 1, 2, 3, 4"""),
    "bucket_bounds": "SELECT CAST(b AS INT) AS bucket, s[(b + 1) * len(s) // 8 + 1] AS bound FROM (SELECT list_sort(list(l_extendedprice)) AS s FROM lineitem), range(7) r(b)",
    "position_order": build("SELECT channel, pos, CAST(row_number() OVER (PARTITION BY channel ORDER BY w DESC, pos) AS INT) AS ord FROM ig"),
    "lineitem_hot_map": """SELECT channel, CAST(val AS INT) AS val, l_returnflag, count(*) AS cnt FROM (
        SELECT 'quantity' AS channel, floor(l_quantity / 10) AS val, l_returnflag FROM lineitem UNION ALL SELECT 'discount', floor(l_discount * 100 + 0.5), l_returnflag FROM lineitem
        UNION ALL SELECT 'tax', floor(l_tax * 100 + 0.5), l_returnflag FROM lineitem) GROUP BY 1, 2, 3""",
    "vote_exact": build("SELECT qid, tid, votes FROM votespx"),
    "vote_multiprobe": build("SELECT qid, tid, CAST(sum(w) AS BIGINT) AS votes FROM pmulti JOIN post USING (channel, pos, val) WHERE channel = 'px' GROUP BY qid, tid"),
    "vote_hamming1_all_indexed": build("SELECT qid, tid, CAST(sum(w) AS BIGINT) AS votes FROM (SELECT * FROM pexact UNION ALL SELECT * FROM nearham) z JOIN postall USING (channel, pos, val) WHERE channel = 'px' GROUP BY qid, tid"),
    "vote_three_channel": build("SELECT qid, tid, votes FROM votes3"),
    "vote_index_join": build("SELECT qid, tid, votes FROM votes3"),
    "vote_kernel": build("SELECT qid, tid, votes FROM votes3"),
    "vote_bagged": build("SELECT bag, qid, tid, votes FROM bagv"),
    "topk_exact": build("SELECT qid, tid, votes, rank FROM top"),
    "topk_threshold_id": build(f"""SELECT qid, tid, votes, CAST(row_number() OVER (PARTITION BY qid ORDER BY votes DESC, tid) AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tid) AS at_ FROM (
        SELECT *, coalesce(max(CASE WHEN rn = {K} THEN votes END) OVER (PARTITION BY qid), 1) AS thr FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, tid) AS rn FROM votes3)) WHERE votes >= thr) WHERE at_ <= {K}"""),
    "pool_merge": build("""SELECT qid, tid, votes, CAST(rank AS INT) AS rank FROM (SELECT qid, tid, votes, row_number() OVER (PARTITION BY qid ORDER BY pool, at_, tid) AS rank FROM (
        SELECT qid, tid, CAST(sum(votes) AS BIGINT) AS votes, min(pool) AS pool, arg_min(rank, pool) AS at_ FROM (
        SELECT qid, tid, votes, rank, 0 AS pool FROM toppx UNION ALL SELECT qid, tid, votes, rank, 1 FROM topvg) GROUP BY qid, tid)) WHERE rank <= 30"""),
    "bag_merge": build("""SELECT qid, tid, bags, votes, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bags DESC, votes DESC, tid) AS rank FROM (
        SELECT qid, tid, count(*) AS bags, CAST(sum(votes) AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY bag, qid ORDER BY votes DESC, tid) AS rn FROM bagv) WHERE rn <= 20 GROUP BY qid, tid)) WHERE rank <= 30"""),
    "profile": build("SELECT id, y AS pos, n FROM prof"),
    "divergence": build("""SELECT n.id, n.ns, n.cy, e.ns AS edge_ns, e.cy AS edge_cy, w.ns AS weighted_ns, w.cy AS weighted_cy FROM neg n
        JOIN (SELECT id, CAST(coalesce(sum(CASE WHEN d < 0 THEN d END), 0) AS INT) AS ns, CAST(coalesce(sum(CASE WHEN d < 0 THEN y END) // nullif(count(CASE WHEN d < 0 THEN 1 END), 0), -1) AS INT) AS cy
              FROM (SELECT id, y, CASE WHEN hg = 0 AND vg = 0 THEN 0 ELSE d END AS d FROM dcell) GROUP BY id) e ON e.id = n.id
        JOIN (SELECT id, CAST(coalesce(sum(CASE WHEN d < 0 THEN d END), 0) AS INT) AS ns, CAST(coalesce(sum(CASE WHEN d < 0 THEN y END) // nullif(count(CASE WHEN d < 0 THEN 1 END), 0), -1) AS INT) AS cy
              FROM (SELECT id, y, d * (abs(hg) + abs(vg)) AS d FROM dcell) GROUP BY id) w ON w.id = n.id"""),
    "grid_divergence": build("SELECT id, region, s FROM gdiv"),
    "grid_divergence_uneven": build("SELECT id, CAST(y * 3 // 8 * 3 + x * 3 // 8 AS INT) AS region, CAST(sum(CASE WHEN d < 0 THEN d ELSE 0 END) AS INT) AS s FROM dcell GROUP BY id, 2"),
    "divergence_histogram": build("SELECT id, CAST(b AS INT) AS bin, CAST(sum(CASE WHEN d + 4 = b THEN 1 ELSE 0 END) AS BIGINT) AS n FROM dcell, range(9) r(b) GROUP BY id, b"),
    "divergence_trits": build("SELECT id, pos, CAST(greatest(-1, least(1, d)) AS INT) AS v FROM dcell"),
    "curl": build("""SELECT id, CAST(coalesce(sum(CASE WHEN c < 0 THEN c END), 0) AS INT) AS ns FROM (
        SELECT id, coalesce(lead(vg) OVER (PARTITION BY id, y ORDER BY x), 0) - vg - (coalesce(lead(hg) OVER (PARTITION BY id, x ORDER BY y), 0) - hg) AS c FROM grad) GROUP BY id"""),
    "euler": build("""SELECT id, CAST(CASE WHEN e < 0 THEN -(-e // 4) ELSE e // 4 END AS INT) AS e FROM (SELECT id, sum(CASE WHEN s = 1 THEN 1 WHEN s = 3 THEN -1 WHEN s = 2 AND a = d THEN 2 ELSE 0 END) AS e FROM (
        SELECT *, a + b + c + d AS s FROM (SELECT p.id, CAST(p.t > 0 AS INT) AS a, CAST(r.t > 0 AS INT) AS b, CAST(u.t > 0 AS INT) AS c, CAST(z.t > 0 AS INT) AS d FROM tern p
        JOIN tern r ON r.id = p.id AND r.x = p.x + 1 AND r.y = p.y JOIN tern u ON u.id = p.id AND u.x = p.x AND u.y = p.y + 1 JOIN tern z ON z.id = p.id AND z.x = p.x + 1 AND z.y = p.y + 1)) GROUP BY id)"""),
    "chirality": build("SELECT id, CAST(y // 2 AS INT) AS pos, CAST(sum(CASE WHEN t > 0 THEN CASE WHEN x < 4 THEN 1 ELSE -1 END ELSE 0 END) AS INT) AS d FROM tern GROUP BY id, y // 2"),
    "local_pattern": build("""SELECT id, CAST((y * 4 // 8 * 4 + x * 4 // 8) * 4 + CASE WHEN k IN (0, 8) THEN 0 WHEN k <= 2 THEN 1 WHEN k >= 6 THEN 2 ELSE 3 END AS INT) AS bin, count(*) AS n FROM (
        SELECT a.id, a.y, a.x, count(*) FILTER (WHERE b.p >= a.p) AS k FROM cell a JOIN cell b ON b.id = a.id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.pos <> a.pos
        WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY a.id, a.y, a.x) GROUP BY 1, 2"""),
    "haar_energy": build("""SELECT id, CAST((y * 4 // 8 * 4 + x * 4 // 8) * 2 + o AS INT) AS bin, CAST(least(32767, sum(CASE WHEN o = 0 THEN abs(gx) ELSE abs(gy) END)) AS BIGINT) AS e FROM stepped, range(2) r(o) GROUP BY 1, 2"""),
    "orientation": build("""SELECT id, CAST((y * 4 // 8 * 4 + x * 4 // 8) * 4 + CASE WHEN vg = 0 THEN 0 WHEN hg = 0 THEN 1 WHEN hg = vg THEN 2 ELSE 3 END AS INT) AS bin, count(*) AS n FROM grad WHERE hg <> 0 OR vg <> 0 GROUP BY 1, 2"""),
    "symmetry": build("SELECT a.id, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS s FROM cell a JOIN cell b ON b.id = a.id AND b.y = a.y AND b.x = 7 - a.x WHERE a.x < 4 GROUP BY a.id"),
    "contrast": build("""SELECT a.id, CAST(count(*) FILTER (WHERE b.y = a.y AND b.x = a.x + 1) AS INT) AS h, CAST(count(*) FILTER (WHERE b.y = a.y + 1 AND b.x = a.x) AS INT) AS v, CAST(count(*) FILTER (WHERE b.y = a.y + 1 AND b.x = a.x + 1) AS INT) AS d
        FROM cell a LEFT JOIN cell b ON b.id = a.id AND abs(a.p - b.p) > 30 AND b.y - a.y IN (0, 1) AND b.x - a.x IN (0, 1) AND b.pos <> a.pos GROUP BY a.id"""),
    "gradient_map": build("SELECT id, bin, n FROM gm"),
    "gradient_state_steps": build("""SELECT id, CAST(m * 8 + o AS INT) AS bin, count(*) AS n FROM (
        SELECT id, m, lead(m) OVER (PARTITION BY id, y ORDER BY x) AS o FROM st UNION ALL SELECT id, m, lead(m) OVER (PARTITION BY id, x ORDER BY y) FROM st) WHERE o IS NOT NULL GROUP BY 1, 2""",
        {"st": "SELECT id, y, x, CASE WHEN hg = 0 AND vg = 0 THEN 0 WHEN vg = 0 THEN CASE WHEN hg > 0 THEN 1 ELSE 2 END WHEN hg = 0 THEN CASE WHEN vg > 0 THEN 3 ELSE 4 END WHEN hg = vg THEN 5 ELSE 6 END AS m FROM grad"}),
    "enclosed_centroid": build("SELECT id, cent FROM cent"),
    "brute_dot": build("""SELECT qid, tid, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS rank FROM (
        SELECT a.id AS qid, b.id AS tid, CAST(sum(a.t * b.t) AS BIGINT) AS score FROM tern a JOIN tern b ON b.pos = a.pos WHERE a.q AND NOT b.q GROUP BY 1, 2)) WHERE rank <= 10"""),
    "brute_sad": build("""SELECT qid, tid, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, tid) AS rank FROM (
        SELECT a.id AS qid, b.id AS tid, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS score FROM cell a JOIN cell b ON b.pos = a.pos WHERE a.q AND NOT b.q GROUP BY 1, 2)) WHERE rank <= 10"""),
    "lsh_hamming": build("""SELECT qid, tid, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, tid) AS rank FROM (
        SELECT a.id AS qid, b.id AS tid, CAST(sum(CAST(a.s <> b.s AS INT)) AS BIGINT) AS score FROM bits a JOIN bits b ON b.bit = a.bit WHERE a.q AND NOT b.q GROUP BY 1, 2)) WHERE rank <= 10""",
        {"bits": "SELECT id, q, bit, sum((p - 128) * w) > 0 AS s FROM cell JOIN (SELECT CAST(a AS INT) AS bit, CAST(b AS INT) AS pos, CAST('0x' || substr(md5(concat_ws('-', 42, a, b)), 1, 4) AS INT) % 3 - 1 AS w FROM range(64) r(a), range(64) t(b)) USING (pos) GROUP BY id, q, bit"}),
    "candidate_features": build("SELECT qid, tid, dot_px, dot_vg, cent_sim, prof_sim, div_sim, gdiv_sim, sad FROM feat"),
    "mad": build("SELECT qid, mad FROM madv"),
    "combined_score": build("SELECT qid, tid, combined, place FROM ranked"),
    "rerank_filtered": build("""SELECT qid, label, arg_max(tlabel, n * 100 - tlabel) AS pred FROM (SELECT qid, label, tlabel, count(*) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY 256 * dot_px + 192 * dot_vg - 50 * abs(q_ns - ns) DESC, votes DESC, tid) AS place FROM (
        SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY qid) AS n_ok FROM (SELECT *, abs(q_ns - ns) < 6 AND (q_cent >= 0) = (cent >= 0) AS ok FROM feat)) WHERE ok OR n_ok < 3) WHERE place <= 3 GROUP BY qid, label, tlabel) GROUP BY qid, label"""),
    "hybrid_sad": build("SELECT qid, label, pred FROM knn", {"kept": "SELECT qid, tid, tlabel, votes, rank FROM (SELECT t.*, row_number() OVER (PARTITION BY t.qid ORDER BY z.sad, t.votes DESC, t.tid) AS sp FROM top t JOIN sads z ON z.qid = t.qid AND z.tid = t.tid) WHERE sp <= 15",
        "sads": "SELECT qid, tid, sum(abs(a.p - b.p)) AS sad FROM top JOIN cell a ON a.id = qid JOIN cell b ON b.id = tid AND b.pos = a.pos GROUP BY qid, tid"}, top="kept"),
    "knn_vote": build("SELECT qid, label, pred FROM knn"),
    "weighted_vote": build("""SELECT qid, label, arg_max(tlabel, v * 100 - tlabel) AS pred FROM (SELECT qid, label, tlabel, sum(combined - low + 1) AS v FROM (
        SELECT *, min(combined) OVER (PARTITION BY qid) AS low FROM ranked WHERE place <= 5) GROUP BY qid, label, tlabel) GROUP BY qid, label"""),
    "adaptive_k": build("""SELECT qid, label, arg_max(tlabel, n * 100 - tlabel) AS pred FROM (SELECT qid, label, tlabel, count(*) AS n FROM ranked
        WHERE place <= CASE WHEN mad < 4 THEN 1 WHEN mad < 8 THEN 3 ELSE 7 END GROUP BY qid, label, tlabel) GROUP BY qid, label"""),
    "skip_vote_if_sure": build("""SELECT qid, label, arg_max(tlabel, n * 100 - tlabel) AS pred FROM (SELECT qid, label, tlabel, count(*) AS n FROM ranked
        WHERE place <= CASE WHEN mad < 5 AND q_ns < -20 THEN 1 ELSE 3 END GROUP BY qid, label, tlabel) GROUP BY qid, label"""),
    "divergence_filtered_vote": build("""SELECT qid, label, arg_max(tlabel, n * 100 - tlabel) AS pred FROM (SELECT qid, label, tlabel, count(*) AS n FROM (
        SELECT *, max(CAST(ok AS INT)) OVER (PARTITION BY qid) AS any_ok FROM (SELECT r.*, abs(gdiv_sim - med) * k <= dev AS ok FROM ranked r JOIN (
        SELECT qid, v[len(v) // 2 + 1] AS med, len(v) AS k, list_sum(list_transform(v, lambda x: abs(x - v[len(v) // 2 + 1]))) AS dev FROM (SELECT qid, list_sort(list(gdiv_sim)) AS v FROM ranked WHERE place <= 7 GROUP BY qid)) m ON m.qid = r.qid WHERE place <= 7))
        WHERE ok OR (any_ok = 0 AND place = 1) GROUP BY qid, label, tlabel) GROUP BY qid, label"""),
    "bayes_sequential": build("""SELECT qid, label, arg_max(cls, v * 100 - cls) AS pred FROM (SELECT q.qid, q.label, cls, coalesce(v, 0) AS v FROM (SELECT DISTINCT qid, label FROM ranked) q CROSS JOIN cls LEFT JOIN (
        SELECT qid, tlabel, sum(CASE WHEN e < 0 THEN -(-e // (1 + place)) ELSE e // (1 + place) END) AS v FROM (SELECT *, (combined + 100 * (div_sim + gdiv_sim)) * 2 AS e FROM ranked WHERE place <= 15) GROUP BY qid, tlabel) s ON s.qid = q.qid AND s.tlabel = cls) GROUP BY qid, label"""),
    "hotmap_classify": build("SELECT qid, label, pred FROM hotpred"),
    "hotmap_weighted": build("""SELECT h.qid, cls, CAST(sum(coalesce(cnt, 0) * w) AS BIGINT) AS score FROM hotq h JOIN ig ON ig.channel = h.channel AND ig.pos = h.pos CROSS JOIN cls
        LEFT JOIN hot ON hot.channel = h.channel AND hot.pos = h.pos AND hot.val = h.val AND hot.label = cls GROUP BY h.qid, cls"""),
    "naive_bayes_argmax": build("""SELECT qid, label, arg_max(cls, s) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v, cls DESC) AS s FROM (
        SELECT h.qid, h.label, cls, round(sum(ln(coalesce(cnt, 0) + 0.5)), 9) AS v FROM hotq h CROSS JOIN cls
        LEFT JOIN hot ON hot.channel = h.channel AND hot.pos = h.pos AND hot.val = h.val AND hot.label = cls GROUP BY h.qid, h.label, cls)) GROUP BY qid, label"""),
    "nearest_centroid": build("""SELECT qid, label, arg_max(cls, s * 100 - cls) AS pred FROM (SELECT t.id AS qid, t.label, c.label AS cls, sum(t.t * c.proto) AS s FROM tern t JOIN (
        SELECT label, pos, CASE WHEN sum(t) > count(*) // 3 THEN 1 WHEN sum(t) < -(count(*) // 3) THEN -1 ELSE 0 END AS proto FROM tern WHERE NOT q GROUP BY label, pos) c ON c.pos = t.pos WHERE t.q GROUP BY 1, 2, 3) GROUP BY qid, label"""),
    "fusion_majority": build("""SELECT h.qid, h.label, CASE WHEN bp = bh OR bp = bv THEN bp WHEN bh = bv THEN bh WHEN mv >= mp AND mv >= mh THEN bv WHEN mp >= mh THEN bp ELSE bh END AS pred FROM hotpred h JOIN ct USING (qid)"""),
    "fusion_borda": build("""SELECT qid, label, arg_max(cls, b * 100 - cls) AS pred FROM (SELECT qid, label, cls, sum(pt) AS b FROM (SELECT qid, label, cls, 10 - row_number() OVER (PARTITION BY qid, channel ORDER BY score DESC, cls) AS pt FROM hs) GROUP BY qid, label, cls) GROUP BY qid, label"""),
    "fusion_v_primary": build("""SELECT x.qid, x.label, CASE WHEN mv > greatest(1, tv) // 10 THEN bv ELSE x.pred END AS pred FROM (SELECT qid, label, arg_max(cls, (2 * v + p) * 100 - cls) AS pred FROM hw GROUP BY qid, label) x JOIN ct USING (qid)"""),
    "fusion_margin": build("""SELECT qid, label, CASE WHEN max(mp + mh + mv) = 0 THEN 0 ELSE arg_max(cls, (p * mp + h * mh + v * mv) * 100 - cls) END AS pred FROM hw JOIN ct USING (qid) GROUP BY qid, label"""),
    "fusion_normalized": build("""SELECT qid, label, arg_max(cls, s) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f, cls DESC) AS s FROM (
        SELECT qid, label, cls, round(round(p / greatest(1, tp)::DOUBLE, 12) + round(h / greatest(1, th)::DOUBLE, 12) + round(v / greatest(1, tv)::DOUBLE, 12), 9) AS f FROM hw JOIN ct USING (qid))) GROUP BY qid, label"""),
    "fusion_gate": build("""SELECT qid, label, arg_max(cls, g * 100 - cls) AS pred FROM (SELECT qid, label, cls, (f * 10000 // greatest(1, max(f) OVER (PARTITION BY qid))) * (h + 1) AS g FROM (SELECT *, (v + 1) * (p + 1) AS f FROM hw)) GROUP BY qid, label"""),
    "series_log": build("""SELECT qid, label, arg_max(cls, s) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f, cls DESC) AS s FROM (
        SELECT qid, label, cls, round((v - tv) / 8.0::DOUBLE + (p - tp) / 4.0::DOUBLE + (h - th) / 2.0::DOUBLE, 9) AS f FROM hw JOIN ct USING (qid))) GROUP BY qid, label"""),
    "vote_concentration": build("SELECT qid, arg_max(tlabel, k * 100 - tlabel) AS best, max(k) AS best_n, CAST(sum(k) AS BIGINT) AS n FROM (SELECT qid, tlabel, count(*) AS k FROM top GROUP BY qid, tlabel) GROUP BY qid"),
    "soft_prior": build("""SELECT v.qid, v.tid, CAST(votes * (1 + score * 4 // greatest(1, tot)) AS BIGINT) AS votes FROM votespx v JOIN (SELECT *, sum(score) OVER (PARTITION BY qid) AS tot FROM hsum) s ON s.qid = v.qid AND s.cls = v.tlabel"""),
    "class_filtered_vote": build("""SELECT v.qid, v.tid, votes FROM votespx v JOIN (SELECT qid, cls, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cls) AS rn FROM hsum) s ON s.qid = v.qid AND s.cls = v.tlabel WHERE rn <= 3"""),
    "confidence_gate": build("""SELECT h.qid, h.label, CASE WHEN gap >= 60 THEN best ELSE coalesce(k.pred, best) END AS pred, CASE WHEN gap >= 60 THEN 'hot' ELSE 'cascade' END AS source FROM (
        SELECT qid, label, arg_max(cls, score * 100 - cls) AS best, list_sort(list(score), 'DESC')[1] - list_sort(list(score), 'DESC')[2] AS gap FROM hsum GROUP BY qid, label) h LEFT JOIN knn k ON k.qid = h.qid"""),
    "oracle_merge": build("""SELECT qid, tid, votes, CAST(rank AS INT) AS rank FROM toppx JOIN uni USING (qid) WHERE agreed UNION ALL
        SELECT qid, tid, votes, CAST(rank AS INT) FROM (SELECT qid, tid, votes, row_number() OVER (PARTITION BY qid ORDER BY pool, at_, tid) AS rank FROM (
        SELECT qid, tid, CAST(sum(votes) AS BIGINT) AS votes, min(pool) AS pool, arg_min(rank, pool) AS at_ FROM (
        SELECT qid, tid, votes, rank, 0 AS pool FROM toppx UNION ALL SELECT qid, tid, votes, rank, 1 FROM topvg) z JOIN uni USING (qid) WHERE NOT agreed GROUP BY qid, tid)) WHERE rank <= 30""",
        {"uni": "SELECT qid, count(DISTINCT tlabel) = 1 AS agreed FROM toppx WHERE rank <= 3 GROUP BY qid"}),
    "group_then_within": build("""SELECT qid, label, arg_max(cls, score * 100 - cls) AS pred FROM (SELECT *, sum(CASE WHEN cls IN (0, 1, 8, 9) THEN score ELSE 0 END) OVER (PARTITION BY qid) AS g1, sum(CASE WHEN cls IN (0, 1, 8, 9) THEN 0 ELSE score END) OVER (PARTITION BY qid) AS g0 FROM hsum)
        WHERE (cls IN (0, 1, 8, 9)) = (g1 > g0) GROUP BY qid, label"""),
    "accuracy_by_label": build("SELECT label, count(*) AS n, CAST(sum(CAST(label = pred AS INT)) AS BIGINT) AS correct FROM hotpred GROUP BY label"),
    "confusion": build("SELECT label, pred, count(*) AS n FROM knn GROUP BY label, pred"),
    "confusion_pairs": build("SELECT least(label, pred) AS a, greatest(label, pred) AS b, count(*) AS n FROM knn WHERE label <> pred GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 10"),
    "error_modes": build("""SELECT CASE WHEN coalesce(there, 0) = 0 THEN 'A' WHEN first = 0 THEN 'B' ELSE 'C' END AS mode, count(*) AS n FROM knn LEFT JOIN (
        SELECT qid, max(CAST(tlabel = label AS INT)) AS there, max(CAST(place = 1 AND tlabel = label AS INT)) AS first FROM ranked GROUP BY qid) USING (qid) WHERE label <> pred GROUP BY 1"""),
    "recall_at_k": build("""SELECT CAST(k AS INT) AS k, count(*) AS n, CAST(sum(CAST(coalesce(at_, 1000000) <= k AS INT)) AS BIGINT) AS found FROM img i CROSS JOIN (VALUES (1), (5), (10), (20), (40)) z(k) LEFT JOIN (
        SELECT t.qid, min(rank) AS at_ FROM top t JOIN img j ON j.id = t.qid WHERE t.tlabel = j.label GROUP BY t.qid) h ON h.qid = i.id WHERE i.q GROUP BY k"""),
    "confidence_map": build("SELECT fold, agree, mad_bucket, gap_bucket, n, correct FROM cmap"),
    "mutual_information": build("""SELECT round(h, 6) AS h, round(hg, 6) AS h_given, round(h - hg, 6) AS mi FROM (SELECT CASE WHEN sum(c) > 0 AND sum(c) < sum(n) THEN -(sum(c) / sum(n)) * log2(sum(c) / sum(n)) - (1 - sum(c) / sum(n)) * log2(1 - sum(c) / sum(n)) ELSE 0.0 END AS h,
        sum(CASE WHEN c > 0 AND c < n THEN n * (-(c / n) * log2(c / n) - (1 - c / n) * log2(1 - c / n)) ELSE 0.0 END) / sum(n) AS hg FROM (SELECT agree, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(correct) AS DOUBLE) AS c FROM cmap GROUP BY agree))"""),
    "grid_search": build("""SELECT wc AS cent, wp AS prof, wd AS div, wg AS gdiv, 50 AS scale, count(*) AS n, CAST(sum(CAST(label = pred AS INT)) AS BIGINT) AS correct FROM (
        SELECT wc, wp, wd, wg, qid, label, arg_max(tlabel, k * 100 - tlabel) AS pred FROM (SELECT wc, wp, wd, wg, qid, label, tlabel, count(*) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY wc, wp, wd, wg, qid ORDER BY 256 * dot_px + 192 * dot_vg + (50 * wc // (50 + mad)) * cent_sim + (50 * wp // (50 + mad)) * prof_sim + (50 * wd // (50 + mad)) * div_sim + (50 * wg // (50 + mad)) * gdiv_sim DESC, votes DESC, tid) AS place
        FROM feat JOIN madv USING (qid), (VALUES (0), (50)) a(wc), (VALUES (0), (16)) b(wp), (VALUES (0), (200)) c(wd), (VALUES (0), (100)) d(wg)) WHERE place <= 3 GROUP BY ALL) GROUP BY ALL) GROUP BY wc, wp, wd, wg"""),
    "k_sweep": build("""SELECT CAST(k AS INT) AS k, count(*) AS n, CAST(sum(CAST(label = pred AS INT)) AS BIGINT) AS correct FROM (SELECT k, qid, label, arg_max(tlabel, c * 100 - tlabel) AS pred FROM (SELECT k, qid, label, tlabel, count(*) AS c FROM (
        SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY combined DESC, votes DESC, tid) AS p FROM ranked, (VALUES (5), (10), (20), (40)) z(k) WHERE rank <= k) WHERE p <= 3 GROUP BY ALL) GROUP BY k, qid, label) GROUP BY k"""),
    "error_profile": build("""SELECT feature, CAST(sum(CAST(NOT ok AS INT)) AS BIGINT) AS wrong_n, CAST(sum(CASE WHEN NOT ok THEN v ELSE 0 END) AS BIGINT) AS wrong_sum, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS right_n, CAST(sum(CASE WHEN ok THEN v ELSE 0 END) AS BIGINT) AS right_sum FROM (
        SELECT label = pred AS ok, unnest(['agree', 'gap', 'mad']) AS feature, unnest([CAST(agree AS BIGINT), CAST(gap AS BIGINT), CAST(mad AS BIGINT)]) AS v FROM knn JOIN agree USING (qid)) GROUP BY feature"""),
    "effect_size": build("SELECT round((avg(CASE WHEN label = pred THEN agree END) - avg(CASE WHEN label <> pred THEN agree END)) / sqrt((var_pop(CASE WHEN label = pred THEN agree END) + var_pop(CASE WHEN label <> pred THEN agree END)) / 2), 6) AS d FROM knn JOIN agree USING (qid)"),
    "disagreement": build("SELECT k.pred = k.label AS a_ok, h.pred = k.label AS b_ok, count(*) AS n FROM knn k JOIN hotpred h ON h.qid = k.qid GROUP BY 1, 2"),
    "accuracy_interval": build("""SELECT n, correct, round(m - w, 6) AS low, round(m + w, 6) AS high FROM (SELECT n, correct, (p + 1.96::DOUBLE * 1.96 / (2 * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS m, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96 / (4 * n * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS w FROM (
        SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(label = pred AS INT)) AS BIGINT) AS correct, CAST(sum(CAST(label = pred AS INT)) AS DOUBLE) / count(*) AS p FROM hotpred))"""),
}
for _rule, _f in {"additive": "p + h + v", "best_two": "p + v", "v_dominant": "2 * p + h + 4 * v"}.items():
    ORACLE_SQL[f"fusion_{_rule}"] = build(f"SELECT qid, label, arg_max(cls, ({_f}) * 100 - cls) AS pred FROM hw GROUP BY qid, label")
ORACLE_SQL["brute_dot_blocks"] = ORACLE_SQL["brute_dot"]


# Queries that need several sets of parts: each set is a query of its own inside.

_PCT = """SELECT c.*, CASE WHEN c.p > z.hi THEN 1 WHEN c.p < z.lo THEN -1 ELSE 0 END AS t FROM cell c JOIN (
    SELECT id, CASE WHEN a = b THEN greatest(a - 1, 0) ELSE a END AS lo, CASE WHEN a = b THEN least(b + 1, 255) ELSE b END AS hi
    FROM (SELECT id, s[22] AS a, s[43] AS b FROM (SELECT id, list_sort(list(p)) AS s FROM cell GROUP BY id))) z ON z.id = c.id"""
_EYES = [None, {"tern": "SELECT *, CASE WHEN p > 192 THEN 1 WHEN p < 64 THEN -1 ELSE 0 END AS t FROM cell"}, {"tern": _PCT}]
ORACLE_SQL["vote_multi_eye"] = "SELECT qid, tid, CAST(sum(votes) AS BIGINT) AS votes FROM (" + " UNION ALL ".join(f"SELECT * FROM ({build('SELECT qid, tid, votes FROM votespx', e)})" for e in _EYES) + ") GROUP BY qid, tid"

_JOINT = {
    "sig0": PARTS["sig"],
    "wide": PARTS["wide"].replace("FROM sig", "FROM sig0"),
    "sig": "SELECT id, label, q, 'joint' AS channel, pos, val FROM joint",
    "adj": "SELECT CAST(a AS INT) AS val, CAST(xor(a, 1 << b) AS INT) AS nval FROM range(256) r(a), range(8) s(b)",
}
ORACLE_SQL["vote_joint_bitflip"] = build("SELECT qid, tid, votes FROM votes3", _JOINT)

_TOPJ = build(f"""SELECT qid, tid, tlabel, votes, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, tid) AS rank FROM (
    SELECT qid, tid, tlabel, CAST(sum(w) AS BIGINT) AS votes FROM pexact JOIN post USING (channel, pos, val) GROUP BY qid, tid, tlabel)) WHERE rank <= {K}""", _JOINT)
_BAYES = """SELECT qid, label, arg_max(cls, v * 100 - cls) AS pred FROM (SELECT q.qid, q.label, cls, coalesce(v, 0) AS v FROM (SELECT DISTINCT qid, label FROM ranked) q CROSS JOIN cls LEFT JOIN (
    SELECT qid, tlabel, sum(CASE WHEN e < 0 THEN -(-e // (1 + place)) ELSE e // (1 + place) END) AS v FROM (SELECT *, (combined + 100 * (div_sim + gdiv_sim)) * 2 AS e FROM ranked WHERE place <= 15) GROUP BY qid, tlabel) s ON s.qid = q.qid AND s.tlabel = cls) GROUP BY qid, label"""
ORACLE_SQL["router_three_tier"] = build("""SELECT i.id AS qid, i.label, CAST(CASE WHEN k >= 12 THEN 1 WHEN k >= 9 THEN 2 ELSE 3 END AS INT) AS tier,
    CASE WHEN k >= 12 THEN best WHEN k >= 9 THEN h.pred ELSE coalesce(b.pred, 0) END AS pred FROM img i LEFT JOIN conc c ON c.qid = i.id LEFT JOIN hotpred h ON h.qid = i.id LEFT JOIN bayes b ON b.qid = i.id WHERE i.q""",
    {"top": f"SELECT * FROM ({_TOPJ})", "bayes": _BAYES, "conc": "SELECT qid, arg_max(tlabel, k * 100 - tlabel) AS best, max(k) AS k FROM (SELECT qid, tlabel, count(*) AS k FROM top GROUP BY qid, tlabel) GROUP BY qid"}, one_sided="0")

ORACLE_SQL["early_exit"] = build("""SELECT qid, label, CAST(ord AS INT) AS ord, pred FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN s[1] * 2 > s[2] * 3 THEN ord ELSE 1000 - ord END) AS at_ FROM (
    SELECT qid, label, ord, arg_max(cls, acc * 100 - cls) AS pred, list_sort(list(acc), 'DESC') AS s FROM (SELECT *, sum(score) OVER (PARTITION BY qid, cls ORDER BY ord) AS acc FROM steps) GROUP BY qid, label, ord)) WHERE at_ = 1""",
    {"steps": """SELECT s.id AS qid, s.label, ord, cls, CAST(coalesce(cnt, 0) AS BIGINT) AS score FROM sig s JOIN (
        SELECT channel, pos, row_number() OVER (ORDER BY w DESC, channel, pos) AS ord FROM ig) o ON o.channel = s.channel AND o.pos = s.pos CROSS JOIN cls
        LEFT JOIN hot ON hot.channel = s.channel AND hot.pos = s.pos AND hot.val = s.val AND hot.label = cls WHERE s.q"""})

_TRUNC = "CASE WHEN ({0}) < 0 THEN -(-({0}) // ({1})) ELSE ({0}) // ({1}) END"
_STEP_H = _TRUNC.format("3 * c.h[k + 1] + CASE WHEN k = r.tlabel THEN 2 * r.ev ELSE -10 END", "4")
_SEQ = f"SELECT *, {_TRUNC.format('combined', '256')} AS ev, {_TRUNC.format('(combined + 100 * (div_sim + gdiv_sim)) * 2', '1 + place')} AS ea FROM ranked"
_START = "SELECT DISTINCT qid, label, 0 AS place, CAST([0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS h FROM seq"
_LAST = "SELECT qid, label, CAST(list_position(h, list_max(h)) - 1 AS INT) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place DESC) AS rn FROM walk) WHERE rn = 1"
ORACLE_SQL["cfc"] = build(_LAST, {"seq": _SEQ, "walk": f"{_START} UNION ALL SELECT c.qid, c.label, r.place, CAST(list_transform(range(10), lambda k: {_STEP_H}) AS BIGINT[]) FROM walk c JOIN seq r ON r.qid = c.qid AND r.place = c.place + 1 WHERE r.place <= 15"})
ORACLE_SQL["pipeline_ab"] = build(_LAST, {"seq": _SEQ, "walk": f"""{_START} UNION ALL SELECT c.qid, c.label, r.place, CAST(list_transform(range(10), lambda k: CASE WHEN r.place <= 5 THEN c.h[k + 1] + CASE WHEN k = r.tlabel THEN r.ea ELSE 0 END ELSE {_STEP_H} END) AS BIGINT[])
    FROM walk c JOIN seq r ON r.qid = c.qid AND r.place = c.place + 1 WHERE r.place <= 15"""})

ORACLE_SQL["quantize_nonzero_percentile"] = build("""SELECT c.id, c.pos, CASE WHEN p > hi THEN 1 WHEN p < lo THEN -1 ELSE 0 END AS v FROM cell c JOIN (
    SELECT id, CASE WHEN nz <= 10 OR a >= b THEN 85 ELSE a END AS lo, CASE WHEN nz <= 10 OR a >= b THEN 170 ELSE b END AS hi FROM (
    SELECT id, nz, CASE WHEN a = 85 THEN 86 ELSE a END AS a, b FROM (
    SELECT id, len(s) AS nz, CASE WHEN len(s) * 33 // 100 < 1 THEN 1 ELSE s[len(s) * 33 // 100] END AS a, CASE WHEN len(s) * 67 // 100 < 1 THEN 1 ELSE s[len(s) * 67 // 100] END AS b
    FROM (SELECT id, coalesce(list_sort(list(p) FILTER (WHERE p > 0)), []) AS s FROM cell GROUP BY id)))) t ON t.id = c.id""")

ORACLE_SQL["pair_revote"] = build("""SELECT qid, label, arg_max(cls, v * 100 - cls) AS pred FROM (SELECT b.qid, b.label, hot.label AS cls, sum(cnt * w) AS v FROM best b JOIN sig s ON s.id = b.qid
    JOIN pairs g ON g.a = b.a AND g.b = b.b AND g.channel = s.channel AND g.pos = s.pos JOIN hot ON hot.channel = s.channel AND hot.pos = s.pos AND hot.val = s.val AND hot.label IN (b.a, b.b) GROUP BY 1, 2, 3) GROUP BY qid, label""",
    {"best": "SELECT qid, label, min(cls) AS a, max(cls) AS b FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cls) AS rn FROM hsum) WHERE rn <= 2 GROUP BY qid, label",
     "two": "SELECT r.a::INT AS a, s.b::INT AS b, channel, pos, val, label, cnt FROM range(10) r(a), range(10) s(b), hot WHERE r.a < s.b AND label IN (r.a, s.b)",
     "pairs": """SELECT a, b, channel, pos, CASE WHEN most > 0 THEN greatest(1, CAST(floor(round(raw / most * 16, 6) + 0.5) AS INT)) ELSE 1 END AS w FROM (
        SELECT *, max(raw) OVER (PARTITION BY a, b, channel) AS most FROM (SELECT a, b, channel, pos, round(hc - he / tot, 9) AS raw FROM (
          SELECT a, b, channel, pos, sum(-n / tot * log2(n / tot)) AS hc, sum(n) AS tot FROM (
            SELECT a, b, channel, pos, label, CAST(sum(cnt) AS DOUBLE) AS n, CAST(sum(sum(cnt)) OVER (PARTITION BY a, b, channel, pos) AS DOUBLE) AS tot FROM two GROUP BY a, b, channel, pos, label) GROUP BY a, b, channel, pos) x
        JOIN (SELECT a, b, channel, pos, sum(CASE WHEN val = bg THEN 0.0 ELSE e END) AS he FROM (
            SELECT *, -cnt * log2(cnt / CAST(sum(cnt) OVER (PARTITION BY a, b, channel, pos, val) AS DOUBLE)) AS e FROM two) JOIN bg USING (channel) GROUP BY a, b, channel, pos) y USING (a, b, channel, pos)))"""})

_EDGE = """SELECT a.id, a.label, a.q, a.pos, a.y, a.x, a.{v} AS v, {alone} bool_or({differs}) AS e FROM grad a JOIN grad b ON b.id = a.id AND abs(a.y - b.y) + abs(a.x - b.x) = 1
    GROUP BY a.id, a.label, a.q, a.pos, a.y, a.x, a.{v}"""
_FIELD = """SELECT a.id, a.label, a.q, a.pos, a.y, a.x, CAST(greatest(-128, least(127, {side} * coalesce(min(abs(a.y - b.y) + abs(a.x - b.x)), 999))) AS INT) AS d
    FROM edge a LEFT JOIN edge b ON b.id = a.id AND b.e GROUP BY a.id, a.label, a.q, a.pos, a.y, a.x, a.v"""
_SIGNED = {"edge": _EDGE.format(v="t", alone="a.t = 0 OR", differs="b.t <> a.t"), "field": _FIELD.format(side="CASE WHEN a.v > 0 THEN -1 WHEN a.v < 0 THEN 1 ELSE 0 END")}
ORACLE_SQL["signed_distance"] = build("SELECT id, pos, d AS v FROM field", _SIGNED)
ORACLE_SQL["edge_distance"] = build("SELECT id, pos, d AS v FROM field", {"edge": _EDGE.format(v="hg", alone="", differs="(b.hg <> 0) <> (a.hg <> 0)"), "field": _FIELD.format(side="CASE WHEN a.v <> 0 THEN -1 ELSE 1 END")})
_HOTPRED = "SELECT qid, label, pred FROM hotpred"
ORACLE_SQL["hotmap_distance_field"] = build(_HOTPRED, _SIGNED | {"chan": "SELECT id, label, q, 'sdf' AS channel, y, x, CASE WHEN d > 0 THEN 1 WHEN d < 0 THEN -1 ELSE 0 END AS t FROM field"})
ORACLE_SQL["gradient_map_regions"] = build("""SELECT id, channel, CAST(y * 2 // 8 * 2 + x * 2 // 8 AS INT) AS region,
    CAST(CASE WHEN a > 10 THEN 30 WHEN a < -10 THEN 0 ELSE 15 END + CASE WHEN b > 10 THEN 10 WHEN b < -10 THEN 0 ELSE 5 END
    + CASE WHEN abs(a) + abs(b) < 5 THEN 0 WHEN abs(a) + abs(b) < 20 THEN 1 WHEN abs(a) + abs(b) < 50 THEN 2 WHEN abs(a) + abs(b) < 100 THEN 3 ELSE 4 END AS INT) AS bin, count(*) AS n
    FROM (SELECT id, y, x, 'r' AS channel, gx AS a, gy AS b FROM stepped UNION ALL SELECT id, y, x, 'g', -gx, -gy FROM stepped) GROUP BY 1, 2, 3, 4""")
_UP = "SELECT qid, tid, k // 3 AS k, min(m) AS m FROM {m} GROUP BY qid, tid, k // 3 HAVING count(*) = 3"
ORACLE_SQL["block_cascade"] = build("""SELECT qid, tid, CAST(sum(m * w) AS BIGINT) AS score FROM (SELECT qid, tid, m, 1 AS w FROM m0 UNION ALL SELECT qid, tid, m, 3 FROM m1
    UNION ALL SELECT qid, tid, m, 9 FROM m2 UNION ALL SELECT qid, tid, m, 27 FROM m3) GROUP BY qid, tid""", {
    "m0": """SELECT qid, tid, a.pos + CASE a.channel WHEN 'px' THEN 0 WHEN 'hg' THEN 16 ELSE 32 END AS k, CAST(a.val = b.val AS INT) AS m
        FROM top JOIN sig a ON a.id = qid JOIN sig b ON b.id = tid AND b.channel = a.channel AND b.pos = a.pos""",
    "m1": _UP.format(m="m0"), "m2": _UP.format(m="m1"), "m3": _UP.format(m="m2")})
_AT_KNOTS = {"sig0": PARTS["sig"], "sig": "SELECT id, label, q, channel, knot AS pos, val FROM sig0 JOIN knotof USING (pos)"}
_KNOT_OF = """SELECT CAST(p AS INT) AS pos, CAST(arg_min(k, ((p // 2 - kp // 2) * (p // 2 - kp // 2) + (p % 2 - kp % 2) * (p % 2 - kp % 2)) * 100 + k) AS INT) AS knot FROM range(16) a(p), knots GROUP BY p"""
ORACLE_SQL["hotmap_uniform_knots"] = build(_HOTPRED, _AT_KNOTS | {"knotof": _KNOT_OF, "knots": "SELECT k, k * 4 AS kp FROM range(4) b(k)"})
ORACLE_SQL["hotmap_variance_knots"] = build(_HOTPRED, _AT_KNOTS | {"knotof": _KNOT_OF, "knots": """SELECT row_number() OVER (ORDER BY s DESC, pos) - 1 AS k, pos AS kp FROM (
    SELECT pos, count(*) * sum(val * val) - sum(val) * sum(val) AS s FROM sig0 WHERE NOT q AND channel = 'px' GROUP BY pos) ORDER BY s DESC, pos LIMIT 4"""})
ORACLE_SQL["hotmap_interpolated"] = build(_HOTPRED, {"hot0": PARTS["hot"], "mix": """SELECT CAST(p AS INT) AS at_, CAST(CASE WHEN j = 0 OR p // 8 * 4 + 4 >= 8 THEN p // 8 * 4 ELSE p // 8 * 4 + 4 END * 2 AS INT) AS pos,
    CASE WHEN j = 0 THEN 1 - (p // 2 % 4) / 4 ELSE (p // 2 % 4) / 4 END AS share FROM range(16) a(p), range(2) b(j)""",
    "hot": "SELECT channel, at_ AS pos, val, label, CAST(floor(sum(cnt * share) + 0.5) AS BIGINT) AS cnt FROM hot0 JOIN mix USING (pos) GROUP BY channel, at_, val, label HAVING floor(sum(cnt * share) + 0.5) > 0"})
ORACLE_SQL["jitter_rescue"] = build("SELECT qid, tid, CAST(sum(votes) AS BIGINT) AS votes FROM (SELECT qid, tid, votes FROM votespx UNION ALL SELECT * FROM extra) GROUP BY qid, tid", {
    "poor": "SELECT id FROM img LEFT JOIN (SELECT qid, count(*) AS n FROM votespx GROUP BY qid) v ON v.qid = id WHERE q AND coalesce(n, 0) < 300",
    "shifted": """SELECT c.id, dx, dy, c.y, c.x, coalesce(n.t, -1) AS t FROM poor JOIN tern c ON c.id = poor.id CROSS JOIN range(-1, 2) a(dx) CROSS JOIN range(-1, 2) b(dy)
        LEFT JOIN tern n ON n.id = c.id AND n.y = c.y - dy AND n.x = c.x - dx WHERE dx <> 0 OR dy <> 0""",
    "shsig": "SELECT id AS qid, 'px' AS channel, CAST(y * 2 + x // 3 AS INT) AS pos, CAST(sum((t + 1) * CASE x % 3 WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 1 END) AS INT) AS val FROM shifted WHERE x < 6 GROUP BY id, dx, dy, y, x // 3",
    "extra": "SELECT qid, tid, w // 2 AS votes FROM shsig JOIN ig USING (channel, pos) JOIN bg USING (channel) JOIN post USING (channel, pos, val) WHERE val <> bg AND w > 1"})
ORACLE_SQL["label_propagation"] = build("""SELECT qid, coalesce(new, pred) AS pred, CAST(CASE WHEN agree >= 9 THEN 0 WHEN n >= 3 THEN 1 ELSE 2 END AS INT) AS wave FROM st LEFT JOIN won USING (qid)""", {
    "st": "SELECT qid, arg_max(tlabel, n * 100 - tlabel) AS pred, max(n) AS agree FROM (SELECT qid, tlabel, count(*) AS n FROM top GROUP BY qid, tlabel) GROUP BY qid",
    "anchors": "SELECT qid AS aid, pred AS cls FROM st WHERE agree >= 9 ORDER BY md5(CAST(qid AS VARCHAR)), qid LIMIT 500",
    "sims": "SELECT qid, aid, cls, sum(a.t * b.t) AS sim FROM st CROSS JOIN anchors JOIN tern a ON a.id = qid JOIN tern b ON b.id = aid AND b.pos = a.pos WHERE agree < 9 GROUP BY qid, aid, cls",
    "nearest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, aid) AS r FROM sims) WHERE r <= 7",
    "won": "SELECT qid, arg_max(cls, n * 100 - cls) AS new, max(n) AS n FROM (SELECT qid, cls, count(*) AS n FROM nearest GROUP BY qid, cls) GROUP BY qid"})
