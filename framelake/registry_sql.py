"""SQL of the merge pipeline for the registered queries: the stages of operators/merge.py as common table expressions.

Every step's names end with a suffix of its own. Tables are keyed by video_id, which sweeps use for a video and a
combination together; `iou` may be an expression of it.
"""

from __future__ import annotations

SIZE = 8  # pixels of a row


def binary(name: str, pixels: str, threshold: float = 0.5) -> str:
    return f"{name} AS (SELECT video_id, id, p FROM (SELECT *, max(w) OVER (PARTITION BY video_id, id) AS top FROM {pixels}) WHERE w >= top * {threshold})"


def leaders(s: str, points: str, radius: float, pick: str) -> str:
    """mem{s} (video_id, id, leader): the points (video_id, k, id, cx, cy), k from 1 in order, scanned one after the other."""
    near = f"sqrt((l.cx - p.cx) ** 2 + (l.cy - p.cy) ** 2) <= {radius}"
    return f"""pt{s} AS ({points}), scan{s}(video_id, k, ls) AS (SELECT video_id, 0, CAST([] AS STRUCT(id BIGINT, cx DOUBLE, cy DOUBLE)[]) FROM (SELECT DISTINCT video_id FROM pt{s})
        UNION ALL SELECT p.video_id, p.k, CASE WHEN len(list_filter(s.ls, lambda l: {near})) = 0 THEN list_append(s.ls, {{'id': p.id, 'cx': p.cx, 'cy': p.cy}}) ELSE s.ls END FROM scan{s} s JOIN pt{s} p ON p.video_id = s.video_id AND p.k = s.k + 1),
        ld{s} AS (SELECT video_id, l.id AS id, l.cx AS cx, l.cy AS cy FROM (SELECT video_id, unnest(arg_max(ls, k)) AS l FROM scan{s} GROUP BY video_id)),
        mem{s} AS (SELECT video_id, id, leader FROM (SELECT p.video_id, p.id, l.id AS leader, row_number() OVER (PARTITION BY p.video_id, p.id ORDER BY {pick}) AS r FROM pt{s} p JOIN ld{s} l ON l.video_id = p.video_id AND {near}) WHERE r = 1)"""


def gather(s: str, pixels: str, times: str, member: str) -> str:
    """px{s} (video_id, id, p, w) and tm{s} (video_id, id, t)."""
    return f"""px{s} AS (SELECT m.video_id, m.leader AS id, x.p, sum(x.w) AS w FROM {pixels} x JOIN {member} m ON m.video_id = x.video_id AND m.id = x.id GROUP BY ALL),
        tm{s} AS (SELECT DISTINCT m.video_id, m.leader AS id, x.t FROM {times} x JOIN {member} m ON m.video_id = x.video_id AND m.id = x.id)"""


def classes(s: str, pairs: str, ids: str) -> str:
    """mem{s}: connected sets of pairs (video_id, a, b), led by their smallest id."""
    return f"""ed{s} AS ({pairs}), sy{s} AS (SELECT video_id, a, b FROM ed{s} UNION SELECT video_id, b, a FROM ed{s}),
        rc{s}(video_id, id, q) AS (SELECT video_id, id, id FROM ({ids}) UNION SELECT r.video_id, r.id, y.b FROM rc{s} r JOIN sy{s} y ON y.video_id = r.video_id AND y.a = r.q),
        mem{s} AS (SELECT video_id, id, min(q) AS leader FROM rc{s} GROUP BY ALL)"""


def pairs(s: str, masks: str) -> str:
    """pr{s} (video_id, a, b, inter, na, nb) of overlapping masks, both ways, and sz{s}."""
    return f"""sz{s} AS (SELECT video_id, id, count(*) AS n FROM {masks} GROUP BY ALL),
        pr{s} AS (SELECT i.*, x.n AS na, y.n AS nb FROM (SELECT u.video_id, u.id AS a, v.id AS b, count(*) AS inter FROM {masks} u JOIN {masks} v ON u.video_id = v.video_id AND u.p = v.p AND u.id <> v.id GROUP BY ALL) i JOIN sz{s} x ON x.video_id = i.video_id AND x.id = a JOIN sz{s} y ON y.video_id = i.video_id AND y.id = b)"""


def overlap_steps(s: str, pixels: str, times: str, iou: str, avg_area: float) -> str:
    """M4 and M5 on pixels and times: px{s}e and tm{s}e."""
    consume = f"((1 + ({iou})) / 2)"
    return ", ".join([
        binary(f"bi{s}c", pixels), pairs(f"{s}c", f"bi{s}c"),
        classes(f"{s}d", f"SELECT video_id, a, b FROM pr{s}c WHERE a < b AND inter / (na + nb - inter) >= {iou}", f"SELECT DISTINCT video_id, id FROM bi{s}c"), gather(f"{s}d", pixels, times, f"mem{s}d"),
        binary(f"bi{s}d", f"px{s}d"), pairs(f"{s}d", f"bi{s}d"),
        f"con{s} AS (SELECT * FROM pr{s}d WHERE inter / nb >= {consume}), gone{s} AS (SELECT DISTINCT video_id, CASE WHEN nb > na THEN b ELSE a END AS id FROM con{s} WHERE greatest(na, nb) > {avg_area})",
        classes(f"{s}f", f"SELECT video_id, a, b FROM con{s} WHERE greatest(na, nb) <= {avg_area}", f"SELECT DISTINCT video_id, id FROM bi{s}d"),
        f"keep{s} AS (SELECT * FROM mem{s}f m WHERE NOT EXISTS (SELECT 1 FROM gone{s} g WHERE g.video_id = m.video_id AND g.id = m.id))", gather(f"{s}e", f"px{s}d", f"tm{s}d", f"keep{s}"),
    ])


def merged(s: str, regions: str, iou: str, min_area: int = 1, avg_area: float = 30, com0: float = 0.6, com: float = 1.0) -> str:
    """M1-M5 on regions (video_id, t, seg, p): px{s}e and tm{s}e."""
    dist = "round(sqrt((l.cx - p.cx) ** 2 + (l.cy - p.cy) ** 2), 9)"
    return ", ".join([
        f"rg{s} AS (SELECT *, (t * 2147483648 + seg)::BIGINT AS id, 1.0::DOUBLE AS w FROM ({regions}))",
        leaders(f"{s}a", f"SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY id) AS k, id, avg(p // {SIZE}) AS cx, avg(p % {SIZE}) AS cy FROM rg{s} GROUP BY video_id, id HAVING count(*) > {min_area}", com0, "l.id"),
        gather(f"{s}a", f"rg{s}", f"rg{s}", f"mem{s}a"), binary(f"bi{s}a", f"px{s}a"),
        leaders(f"{s}b", f"SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY id) AS k, id, avg(p // {SIZE}) AS cx, avg(p % {SIZE}) AS cy FROM bi{s}a GROUP BY video_id, id", com, f"{dist}, l.id"),
        gather(f"{s}b", f"px{s}a", f"tm{s}a", f"mem{s}b"),
        overlap_steps(s, f"px{s}b", f"tm{s}b", iou, avg_area),
    ])


def joined(s: str, old: tuple[str, str], new: tuple[str, str], iou: str) -> str:
    """M9: px{s} and tm{s} of new masks (pixels, times) merged into old ones."""
    return ", ".join([
        binary(f"bo{s}", old[0]), binary(f"bn{s}", new[0]),
        f"so{s} AS (SELECT video_id, id, count(*) AS n FROM bo{s} GROUP BY ALL), sn{s} AS (SELECT video_id, id, count(*) AS n FROM bn{s} GROUP BY ALL)",
        f"hit{s} AS (SELECT i.video_id, i.id, i.old, inter / (x.n + y.n - inter) AS iou, inter / least(x.n, y.n) AS cover FROM (SELECT n.video_id, n.id, o.id AS old, count(*) AS inter FROM bn{s} n JOIN bo{s} o ON o.video_id = n.video_id AND o.p = n.p GROUP BY ALL) i JOIN sn{s} x ON x.video_id = i.video_id AND x.id = i.id JOIN so{s} y ON y.video_id = i.video_id AND y.id = i.old)",
        f"to{s} AS (SELECT n.video_id, n.id, coalesce(h.old, n.id) AS leader FROM sn{s} n LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY video_id, id ORDER BY iou DESC, old) AS r FROM hit{s} WHERE iou >= {iou} OR cover >= (1 + ({iou})) / 2) h ON h.video_id = n.video_id AND h.id = n.id AND h.r = 1)",
        gather(f"{s}n", *new, f"to{s}"),
        f"px{s} AS (SELECT video_id, id, p, sum(w) AS w FROM (SELECT * FROM {old[0]} UNION ALL SELECT * FROM px{s}n) GROUP BY ALL), tm{s} AS (SELECT * FROM {old[1]} UNION SELECT * FROM tm{s}n)",
    ])


def windowed(s: str, regions: str, iou: str, every: int, windows: int) -> str:
    """M8 and M9 over windows of `every` frames, `windows` of them (frames beyond would be missing), and M11's merges: px{s}xe, tm{s}xe."""
    parts, state = [], None
    for k in range(windows):
        parts.append(merged(f"{s}w{k}", f"SELECT * FROM {regions} WHERE t >= {every * k} AND t < {every * (k + 1)}", iou))
        new = (f"px{s}w{k}e", f"tm{s}w{k}e")
        if state:
            parts.append(joined(f"{s}j{k}", state, new, iou))
        state = (f"px{s}j{k}", f"tm{s}j{k}") if state else new
    return ", ".join([*parts, overlap_steps(f"{s}x", *state, iou, 30)])


def regions(name: str, active: str) -> str:
    """name (video_id, t, seg, p): 4-connected regions of active pixels (video_id, t, x, y, p) of frames."""
    return f"""ac{name} AS ({active}), ne{name} AS (SELECT a.video_id, a.t, a.p AS a, b.p AS b FROM ac{name} a JOIN ac{name} b ON a.video_id = b.video_id AND a.t = b.t AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
        fl{name}(video_id, t, p, q) AS (SELECT video_id, t, p, p FROM ac{name} UNION SELECT r.video_id, r.t, r.p, e.b FROM fl{name} r JOIN ne{name} e ON e.video_id = r.video_id AND e.t = r.t AND e.a = r.q),
        {name} AS (SELECT video_id, t, min(q) AS seg, p FROM fl{name} GROUP BY video_id, t, p)"""


SUMMARY = "SELECT video_id, id, pixels, {weight} frames FROM (SELECT video_id, id, count(*) AS pixels, round(sum(w), 6) AS weight FROM {px} GROUP BY ALL) JOIN (SELECT video_id, id, count(*) AS frames FROM {tm} GROUP BY ALL) USING (video_id, id)"


def final(s: str) -> str:
    """The last masks, binarised: fin (video_id, id, p, w)."""
    return f"fin AS (SELECT video_id, id, p, w FROM (SELECT *, max(w) OVER (PARTITION BY video_id, id) AS top FROM px{s}e) WHERE w >= top * 0.5)"


def sweep(emb: str, chain: str, s: str) -> str:
    """Scores of embedding videos by (thresh_pmap, thresh_iou, cons), the other parameters being one value each. A video and a
    combination are 4 * video + 2 * (thresh_pmap = 60) + (thresh_iou = 0.7). Labelled masks are disjoint, so a found mask
    has one candidate at most, and the pairs of the best assignment are the labelled masks that have any."""
    return f"""{emb}, img AS (SELECT video_id, 0 AS t, x, y, p FROM emb GROUP BY ALL HAVING avg(v) > 0.02), {regions("lab", "SELECT * FROM img")},
        cut AS (SELECT 0 AS k, 46 / 256 AS level UNION ALL SELECT 1, 61 / 256), usable AS (SELECT video_id, k, level FROM emb, cut GROUP BY ALL HAVING avg((v > level)::INTEGER) <= 0.1),
        {regions("reg", "SELECT emb.video_id * 2 + k AS video_id, t, x, y, p FROM emb JOIN usable USING (video_id) WHERE v > level")},
        each AS (SELECT video_id * 2 + o AS video_id, t, seg, p FROM reg, (SELECT unnest([0, 1]) AS o)), {chain}, {final(s)},
        isl AS (SELECT video_id, id, t - row_number() OVER (PARTITION BY video_id, id ORDER BY t) AS g FROM tm{s}e), run AS (SELECT video_id, id, max(n) AS longest FROM (SELECT video_id, id, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL),
        found AS (SELECT f.video_id, cons, id, count(*) AS n FROM fin f JOIN run USING (video_id, id), (SELECT unnest([1, 2]) AS cons) WHERE longest >= cons GROUP BY ALL),
        gsz AS (SELECT video_id, seg, count(*) AS n FROM lab GROUP BY ALL),
        cand AS (SELECT i.video_id, i.id, i.seg, inter / (f.n + g.n - inter) AS iou FROM (SELECT f.video_id, f.id, l.seg, count(*) AS inter FROM fin f JOIN lab l ON l.video_id = f.video_id // 4 AND l.p = f.p GROUP BY ALL) i JOIN (SELECT video_id, id, count(*) AS n FROM fin GROUP BY ALL) f ON f.video_id = i.video_id AND f.id = i.id JOIN gsz g ON g.video_id = i.video_id // 4 AND g.seg = i.seg),
        cell AS (SELECT v.video_id * 4 + c.o AS video_id, cons, n_gt FROM (SELECT video_id, count(*) AS n_gt FROM gsz GROUP BY video_id) v, (SELECT unnest([0, 1, 2, 3]) AS o) c, (SELECT unnest([1, 2]) AS cons)),
        cnt AS (SELECT cell.*, (SELECT count(*) FROM found f WHERE f.video_id = cell.video_id AND f.cons = cell.cons) AS n_found, (SELECT count(DISTINCT c.seg) FROM cand c JOIN found f ON f.video_id = c.video_id AND f.id = c.id AND f.cons = cell.cons WHERE c.video_id = cell.video_id AND c.iou >= 0.5) AS n_match FROM cell),
        sc AS (SELECT video_id // 4 AS video_id, 1 AS min_area, 30 AS avg_area, CASE WHEN video_id % 4 >= 2 THEN 60 ELSE 45 END AS thresh_pmap, 1.0::DOUBLE AS thresh_com, CASE WHEN video_id % 2 = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS thresh_iou, cons,
               CASE WHEN n_match > 0 THEN n_match / n_gt ELSE 0 END AS recall, CASE WHEN n_match > 0 THEN n_match / n_found ELSE 0 END AS precision, CASE WHEN n_match > 0 THEN 2.0 * n_match / (n_gt + n_found) ELSE 0 END AS f1 FROM cnt)"""


IOU = "CASE WHEN video_id % 2 = 1 THEN 0.7 ELSE 0.5 END"
