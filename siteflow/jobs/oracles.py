"""DuckDB SQL giving the same rows as the registered queries, put together from named common table expressions."""

from __future__ import annotations

from math import exp, log, pi, sin

#: name -> (expressions it reads, body). Quantities are whole numbers, so their sums are exact in any order.
CTES: dict[str, tuple[list[str], str]] = {
    "raw": (
        [],
        """SELECT CAST(x.a AS INT) AS c0, CAST(y.b AS INT) AS c1, CAST(x.a * 50 + y.b AS BIGINT) AS site, CAST(z.t AS INT) AS t, CAST(coalesce(q.v, 0) AS DOUBLE) AS v
        FROM range(50) x(a), range(50) y(b), range(7) z(t) LEFT JOIN (SELECT l_partkey % 50 AS a, l_suppkey % 50 AS b, year(l_shipdate) - 1995 AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) q
        ON q.a = x.a AND q.b = y.b AND q.t = z.t""",
    ),
    "cube": (
        ["raw"],
        """SELECT c0, c1, site, t, v * CASE WHEN c0 % 10 < 3 AND c1 % 10 < 3 THEN CASE (c0 // 10 + c1 // 10) % 3 WHEN 0 THEN 40 - 5 * t WHEN 1 THEN 10 + 4 * t ELSE 20 END ELSE 1 END AS v FROM raw""",
    ),
    "solid": (
        [],
        """SELECT CAST(x.a AS INT) AS c0, CAST(y.b AS INT) AS c1, CAST(w.c AS INT) AS c2, CAST((x.a * 20 + y.b) * 20 + w.c AS BIGINT) AS site, CAST(z.t AS INT) AS t, CAST(coalesce(q.v, 0) AS DOUBLE) AS v
        FROM range(7) x(a), range(20) y(b), range(20) w(c), range(7) z(t)
        LEFT JOIN (SELECT l_linenumber % 7 AS a, l_partkey % 20 AS b, l_suppkey % 20 AS c, year(l_shipdate) - 1995 AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) q
        ON q.a = x.a AND q.b = y.b AND q.c = w.c AND q.t = z.t""",
    ),
    "ord": (
        [],
        """SELECT p.site, CAST(z.t AS INT) AS t, CAST(coalesce(q.v, 0) AS DOUBLE) AS v FROM (SELECT DISTINCT l_partkey * 7 + l_linenumber % 7 AS site FROM lineitem) p, range(7) z(t)
        LEFT JOIN (SELECT l_partkey * 7 + l_linenumber % 7 AS site, year(l_shipdate) - 1995 AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) q ON q.site = p.site AND q.t = z.t""",
    ),
    "olm": (["ord"], "SELECT site, ln(sum(v) / 7) AS x FROM ord GROUP BY site HAVING sum(v) > 0"),
    "oxm": (["ord"], "SELECT site, t, v / nullif(avg(v) OVER (PARTITION BY site), 0) - 1 AS v FROM ord"),
    "sxm": (["solid", "skept"], "SELECT site, t, v / nullif(avg(v) OVER (PARTITION BY site), 0) - 1 AS v FROM solid JOIN skept USING (site)"),
    "svar": (["sxm"], "SELECT site, stddev_pop(v) >= 0.3 AS high FROM sxm GROUP BY site"),
    "shx": (["sxm", "svar"], "SELECT site, t, v FROM sxm JOIN svar USING (site) WHERE high"),
    "lm": (["cube"], "SELECT site, ln(sum(v) / 7) AS x FROM cube GROUP BY site HAVING sum(v) > 0"),
    "kept": (["lm"], "SELECT site FROM lm WHERE x > (SELECT avg(x) + 2 * stddev_pop(x) FROM lm)"),
    "slm": (["solid"], "SELECT site, ln(sum(v) / 7) AS x FROM solid GROUP BY site HAVING sum(v) > 0"),
    "skept": (["slm"], "SELECT site FROM slm WHERE x > (SELECT avg(x) + 2 * stddev_pop(x) FROM slm)"),
    "kc": (["cube", "kept"], "SELECT site, t, v FROM cube JOIN kept USING (site)"),
    "xm": (["kc"], "SELECT site, t, v / nullif(avg(v) OVER (PARTITION BY site), 0) - 1 AS v FROM kc"),
    "reach": (
        ["kept"],
        """SELECT a.site AS i, b.site AS j, a.site // 50 - b.site // 50 AS dx, a.site % 50 - b.site % 50 AS dy FROM kept a, kept b""",
    ),
    "comp": (
        ["reach"],
        """SELECT i AS site, i AS root FROM reach WHERE i = j UNION SELECT r.j, c.root FROM comp c JOIN reach r ON r.i = c.site AND abs(dx) <= 1 AND abs(dy) <= 1""",
    ),
    "roots": (["comp"], "SELECT site, min(root) AS root FROM comp GROUP BY site"),
    "peaks": (["roots"], "SELECT site, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS peak FROM roots"),
    "pxm": (
        ["peaks", "cube"],
        "SELECT site, t, v / nullif(avg(v) OVER (PARTITION BY site), 0) - 1 AS v FROM (SELECT peak AS site, t, avg(v) AS v FROM cube JOIN peaks USING (site) GROUP BY peak, t)",
    ),
    "sreach": (
        ["skept"],
        """SELECT a.site AS i, b.site AS j FROM skept a, skept b WHERE abs(a.site // 400 - b.site // 400) <= 1 AND abs(a.site // 20 % 20 - b.site // 20 % 20) <= 1 AND abs(a.site % 20 - b.site % 20) <= 1""",
    ),
    "scomp": (["sreach"], "SELECT i AS site, i AS root FROM sreach WHERE i = j UNION SELECT r.j, c.root FROM scomp c JOIN sreach r ON r.i = c.site"),
    "speaks": (
        ["scomp"],
        "SELECT site, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS peak FROM (SELECT site, min(root) AS root FROM scomp GROUP BY site)",
    ),
    "near": (["reach"], f"SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM reach WHERE dx * dx + dy * dy < {log(100)!r}"),
    "hp": (
        ["lm"],
        """SELECT n, lo, hi, m, sd, iqr, iqr / pow(n, 1.0 / 3) AS w, CAST(ceil((hi - lo) / (iqr / pow(n, 1.0 / 3))) AS BIGINT) AS nb FROM (
        SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_pop(x) AS sd,
               max(x) FILTER (k = CAST(round_even(c * 0.75, 0) AS BIGINT)) - max(x) FILTER (k = CAST(round_even(c * 0.25, 0) AS BIGINT)) AS iqr
        FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k, count(*) OVER () AS c FROM lm))""",
    ),
    "bins": (
        ["hp", "lm"],
        """SELECT CAST(b.i AS INT) AS bin, lo + (hi - lo) * b.i / nb AS left_edge, coalesce(c.n, 0) AS n, coalesce(c.s, 0) AS s, coalesce(c.ss, 0) AS ss, coalesce(c.n, 0) / (hp.n * w) AS density
        FROM hp, range((SELECT nb FROM hp)) b(i) LEFT JOIN (SELECT least(CAST(floor((x - lo) / (hi - lo) * nb) AS BIGINT), nb - 1) AS bin, count(*) AS n, sum(x) AS s, sum((x - m) * (x - m)) AS ss
        FROM lm, hp GROUP BY 1) c ON c.bin = b.i""",
    ),
    "cum": (["bins"], "SELECT bin + 1 AS i, sum(n) OVER u AS c, sum(s) OVER u AS s, sum(ss) OVER u AS ss FROM bins WINDOW u AS (ORDER BY bin)"),
    "fit": (
        ["cum", "hp"],
        """SELECT i, s / c AS mean, greatest(sqrt(greatest(0, ss / c - (s / c - m) * (s / c - m))), 2.220446049250313e-16) AS sd, greatest(c / (hp.n * w) * (hi - lo) / nb, 2.220446049250313e-16) AS mass FROM cum, hp""",
    ),
    "kl": (
        ["fit", "bins"],
        f"""SELECT i, sum(CASE WHEN p > 0 THEN p * ln(p / q) ELSE 0 END) AS kl FROM (SELECT i, density / mass AS p, exp(-0.5 * ((left_edge - mean) / sd) * ((left_edge - mean) / sd)) / (sd * sqrt({2 * pi!r})) + 1e-12 AS q FROM fit JOIN bins ON bin < i) GROUP BY i""",
    ),
    "start": (
        ["bins", "hp"],
        """SELECT greatest(CASE WHEN i >= nb THEN peak - 2 ELSE i END, 0) AS i FROM (SELECT peak, nb, CAST(trunc(0.5 * peak + 0.5 * (SELECT count(*) FROM bins WHERE left_edge < m + sd)) AS BIGINT) AS i
        FROM hp, (SELECT arg_min(bin, (-n, bin)) AS peak FROM bins))""",
    ),
    "walk": (
        ["start", "kl", "bins", "hp"],
        """SELECT i, CAST('inf' AS DOUBLE) AS step, 0 AS turn FROM start UNION ALL
        SELECT CASE WHEN isinf(move) OR go >= nb THEN greatest(nb - 2, 0) ELSE go END, abs(move), turn + 1 FROM (
            SELECT nb, turn, move, CASE WHEN isinf(move) THEN nb ELSE (SELECT count(*) FROM bins b WHERE b.left_edge < lo + (hi - lo) * x.i / nb - move) END AS go FROM (
                SELECT r.i, r.turn, nb, lo, hi, CASE WHEN abs(move) < 1e-9 THEN 0 ELSE move END AS move FROM (
                    SELECT r.i, r.turn, nb, lo, hi, CASE WHEN r.i > 0 THEN ln(greatest(b.kl, 2.220446049250313e-16)) - ln(greatest(a.kl, 2.220446049250313e-16)) ELSE CAST('-inf' AS DOUBLE) END AS move
                    FROM walk r, hp LEFT JOIN kl a ON a.i = least(r.i, nb - 1) LEFT JOIN kl b ON b.i = least(r.i + 1, nb - 1) WHERE r.step > w AND r.turn < 100) r) x)""",
    ),
    "cutat": (["walk", "hp"], "SELECT i, lo + (hi - lo) * i / nb AS value FROM (SELECT arg_max(i, turn) AS i FROM walk), hp"),
    "vec": ([], "SELECT vec_id AS site, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"),
    "pvec": (["vec"], "SELECT CAST(b.site AS INT) AS k, b.t, 0.25 AS w, b.v AS mu, greatest(s.var, 1e-12) AS var FROM vec b JOIN (SELECT t, var_pop(v) AS var FROM vec GROUP BY t) s USING (t) WHERE b.site < 4"),
    "p0": (
        ["xm"],
        """SELECT CAST(b.site // 10 AS INT) AS k, b.t, 1.0 / (SELECT count(*) FROM (SELECT DISTINCT site FROM xm WHERE site IN (0, 10, 20))) AS w, b.v AS mu, greatest(s.var, 1e-12) AS var
        FROM xm b JOIN (SELECT t, var_pop(v) AS var FROM xm GROUP BY t) s USING (t) WHERE b.site IN (0, 10, 20)""",
    ),
}


def responsibilities(name: str, x: str, p: str) -> str:
    """Adds the E-step of table x under parameters p as `name` (site, k, r, lse)."""
    CTES[f"{name}_d"] = (
        [x, p],
        f"SELECT site, k, any_value(w) AS w, -0.5 * (count(*) * ln({2 * pi!r}) + sum(ln(greatest(var, 1e-12))) + sum((v - mu) * (v - mu) / greatest(var, 1e-12))) AS ld FROM {x} JOIN {p} USING (t) GROUP BY site, k",
    )
    CTES[f"{name}_e"] = ([f"{name}_d"], f"SELECT site, k, w, ld, w * exp(ld - max(ld) OVER (PARTITION BY site)) AS e, max(ld) OVER (PARTITION BY site) AS top FROM {name}_d")
    CTES[name] = ([f"{name}_e"], f"SELECT site, k, e / greatest(sum(e) OVER (PARTITION BY site), 1e-300) AS r, top + ln(sum(e) OVER (PARTITION BY site)) AS lse FROM {name}_e")
    return name


def maximised(name: str, x: str, r: str, p: str, eta: float = 1.0, reg: float = 0.0) -> str:
    """Adds the M-step as `name` (k, t, w, mu, var)."""
    CTES[f"{name}_s"] = ([x, r], f"SELECT k, t, count(*) AS n, sum(r) AS s0, greatest(sum(r), count(*) * 1e-10) AS d, sum(r * v) AS s1 FROM {x} JOIN {r} USING (site) GROUP BY k, t")
    CTES[f"{name}_v"] = ([f"{name}_s", x, r], f"SELECT k, t, any_value(s0 / n) AS w, any_value(s1 / d) AS mu, sum(r * (v - s1 / d) * (v - s1 / d)) / any_value(d) + {reg!r} AS var FROM {x} JOIN {r} USING (site) JOIN {name}_s USING (k, t) GROUP BY k, t")
    CTES[name] = ([f"{name}_v", p], f"SELECT n.k, n.t, n.w, {1 - eta!r} * o.mu + {eta!r} * n.mu AS mu, {1 - eta!r} * o.var + {eta!r} * n.var AS var FROM {name}_v n JOIN {p} o USING (k, t)")
    return name


def steps(name: str, x: str, p: str, etas: list[float], reg: float = 0.0) -> str:
    for n, eta in enumerate(etas, 1):
        p = maximised(f"{name}{n}", x, responsibilities(f"{name}{n}r", x, p), p, eta, reg)
    return p


def step_size(epoch: int) -> float:
    return (epoch + 2) ** -0.7


responsibilities("rv", "vec", "pvec")
VEC1 = maximised("mv", "vec", "rv", "pvec")
EM3 = steps("em", "xm", "p0", [1.0] * 3, 1e-6)
STEP3 = steps("sw", "xm", "p0", [step_size(k) for k in range(3)])
responsibilities("rl", "xm", EM3)
CTES["labels"] = (["rl"], "SELECT site, CAST(arg_min(k, (-r, k)) AS INT) AS label FROM rl GROUP BY site")
responsibilities("r0", "xm", "p0")
CTES["r0s"] = (["near", "r0"], "SELECT i AS site, k, sum(w * r) AS r FROM near JOIN r0 ON r0.site = near.j GROUP BY i, k")
maximised("sm1", "xm", "r0s", "p0", step_size(0))
responsibilities("r1", "xm", "sm1")
CTES["r1s"] = (["near", "r1"], "SELECT i AS site, k, sum(w * r) AS r FROM near JOIN r1 ON r1.site = near.j GROUP BY i, k")
maximised("sm2", "xm", "r1s", "sm1", step_size(1))

_PERIODIC = [(a, b) for a in range(10) for b in range(10) if exp(-(sin(pi * a / 10) ** 2 + sin(pi * b / 10) ** 2) / 0.04) > 1e-2]
CTES["cls"] = (["kept"], "SELECT site, site // 50 % 10 * 10 + site % 50 % 10 AS class FROM kept")
for _n, _x, _p, _new in ((0, "r0", "p0", "pq1"), (1, "pr1", "pq1", "pq2")):
    if _n:
        responsibilities(_x, "xm", _p)
    CTES[f"{_x}q"] = (["cw", "cls", _x], f"SELECT c.site, k, sum(w * s) AS r FROM cls c JOIN cw USING (class) JOIN (SELECT class AS other, k, sum(r) AS s FROM {_x} JOIN cls USING (site) GROUP BY class, k) USING (other) GROUP BY c.site, k")
    maximised(_new, "xm", f"{_x}q", _p, step_size(_n))
CTES["offs"] = ([], "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in _PERIODIC) + ") o(da, db)")
CTES["cn"] = (["cls"], "SELECT class, count(*) AS n FROM cls GROUP BY class")
CTES["cw"] = (
    ["cn", "offs"],
    "SELECT a.class, b.class AS other, 1.0 / sum(b.n) OVER (PARTITION BY a.class) AS w FROM cn a, offs, cn b WHERE b.class = (a.class // 10 + da) % 10 * 10 + (a.class % 10 + db) % 10",
)


def sql(need: list[str], final: str) -> str:
    """WITH clause of everything needed, in order, and the final query."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for d in CTES[name][0]:
                visit(d)
            order.append(name)

    for n in need:
        visit(n)
    plain = [n for n in order if n not in ("comp", "scomp", "fcomp", "walk")]
    parts = ", ".join(f"{n} AS {'MATERIALIZED ' if n in plain else ''}({CTES[n][1]})" for n in order)
    return (f"WITH RECURSIVE {parts} {final}") if parts else final


R = "round({0}, 6) + 0.0 AS {1}".format
PARAMS = f"SELECT k, t, {R('w', 'w')}, {R('mu', 'mu')}, {R('var', 'var')} FROM "

ORACLES = {
    "cube_dense": sql(["cube"], "SELECT c0, c1, site, t, v FROM cube"),
    "cube_solid": sql(["solid"], "SELECT c0, c1, c2, site, t, v FROM solid"),
    "cube_slice": sql(["cube"], "SELECT c0, c1, site, t, v FROM cube WHERE t + 1995 BETWEEN 1996 AND 1999 AND c0 / 10.0 BETWEEN 0.3 AND 1.2 AND c1 / 10.0 <= 4.0"),
    "cube_loaded": sql(["cube"], "SELECT c0, c1, site, t, v FROM cube WHERE t + 1995 BETWEEN 1996 AND 1999 AND c0 / 10.0 BETWEEN 0.3 AND 1.2 AND c1 / 10.0 <= 4.0"),
    "cube_from_arrays": f"SELECT CAST(i // 8 AS INT) AS c0, CAST(i % 8 AS INT) AS c1, CAST(i AS BIGINT) AS site, vec_id AS t, {R('v', 'v')} FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "order_cube": sql(["ord"], "SELECT site, t, v FROM ord"),
    "order_kept": sql(["olm"], "SELECT site FROM olm WHERE x > (SELECT avg(x) + 2 * stddev_pop(x) FROM olm)"),
    "order_rescaled": sql(["oxm"], f"SELECT site, t, {R('v', 'v')} FROM oxm"),
    "nearest_axis_index": "SELECT value, CAST(arg_min(p, (abs(p / 10 - value), p)) AS INT) AS pos, arg_min(p / 10, (abs(p / 10 - value), p)) AS axis_value, min(abs(p / 10 - value)) = 0 AS exact FROM (SELECT DISTINCT l_quantity / 16 AS value FROM lineitem), (SELECT CAST(i AS DOUBLE) AS p FROM range(50) r(i)) GROUP BY value",
    "mask_zero_mean": sql(["raw"], "SELECT site, sum(v) / 7 > 0 AS kept FROM raw GROUP BY site"),
    "mask_any_zeros": sql(["raw"], "SELECT site, min(v) > 0 AS kept FROM raw GROUP BY site"),
    "mask_complement": sql(["raw"], "SELECT site, t, v, min(v) OVER (PARTITION BY site) > 0 AS kept FROM raw"),
    "log_mean": sql(["lm"], f"SELECT site, {R('x', 'x')} FROM lm"),
    "fd_bin_width": sql(["hp"], f"SELECT n, {R('iqr', 'iqr')}, {R('w', 'width')} FROM hp"),
    "histogram_density": sql(["bins"], f"SELECT bin, {R('left_edge', 'left_edge')}, n, {R('density', 'density')} FROM bins"),
    "cutoff_plot": sql(["bins", "hp"], f"SELECT bin, {R('density', 'density')}, {R(f'exp(-0.5 * ((left_edge - m) / sd) * ((left_edge - m) / sd)) / (sd * sqrt({2 * pi!r}))', 'pdf')}, left_edge > m + 2 * sd AS beyond FROM bins, hp"),
    "kl_by_index": sql(["kl"], "SELECT i, round(kl, 5) AS kl FROM kl"),
    "kl_cutoff": sql(["cutat", "lm"], "SELECT site FROM lm, cutat WHERE x > value"),
    "kl_diagnostics": sql(
        ["cutat", "fit", "hp"], f"SELECT {R('value', 'cutoff')}, CAST(c.i AS INT) AS i, {R('f.mean', 'mean')}, {R('f.sd', 'std')}, value BETWEEN m - hp.sd AND m + 2 * hp.sd AS success FROM cutat c, hp, fit f WHERE f.i = greatest(c.i, 1)"
    ),
    "simple_cutoff": sql(["kept"], "SELECT site FROM kept"),
    "no_threshold": sql(["lm"], "SELECT site FROM lm"),
    "threshold_volume": sql(["kept"], "SELECT CAST(s // 50 AS INT) AS c0, CAST(s % 50 AS INT) AS c1, CAST(kept.site IS NOT NULL AS INT) AS value FROM range(2500) g(s) LEFT JOIN kept ON site = s"),
    "high_variance_split": sql(["xm"], f"SELECT site, {R('stddev_pop(v)', 'std')}, stddev_pop(v) >= 0.3 AS high FROM xm GROUP BY site"),
    "rescale_mean": sql(["xm"], f"SELECT site, t, {R('v', 'v')} FROM xm"),
    "rescale_zscore": sql(["kc"], f"SELECT site, t, {R('(v - avg(v) OVER s) / nullif(stddev_pop(v) OVER s, 0)', 'v')} FROM kc WINDOW s AS (PARTITION BY site)"),
    "rescale_log_mean": sql(["kc"], f"SELECT site, t, {R('ln(1 + v) - avg(ln(1 + v)) OVER (PARTITION BY site)', 'v')} FROM kc"),
    "peak_labels_2d": sql(["peaks"], "SELECT site, peak FROM peaks"),
    "peak_labels_3d": sql(["speaks"], "SELECT site, peak FROM speaks"),
    "peak_trajectories": sql(["peaks", "cube"], f"SELECT peak, t, {R('avg(v)', 'v_mean')}, max(v) AS v_max FROM cube JOIN peaks USING (site) GROUP BY peak, t"),
    "peak_sizes": sql(["peaks"], "SELECT peak, count(*) AS n, min(site) AS first_site FROM peaks GROUP BY peak"),
    "pixel_labels": sql(["peaks"], "SELECT site, peak, CAST(min(site) OVER (PARTITION BY peak) % 3 AS INT) AS label FROM peaks"),
    "edges_local": sql(["near"], f"SELECT i, j, {R('w', 'w')} FROM near"),
    "edges_gaussian_weights": sql(["reach"], f"SELECT i, j, {R('exp(-(dx * dx + dy * dy)) / sum(exp(-(dx * dx + dy * dy))) OVER (PARTITION BY i)', 'w')} FROM reach WHERE dx * dx + dy * dy < {log(100)!r}"),
    "edges_periodic": sql(["cw"], "SELECT class, other, round(w, 9) AS w FROM cw"),
    "unit_cell_shape": "WITH a AS (SELECT DISTINCT l_partkey % 50 AS p FROM lineitem), f AS (SELECT min(p / 10.0) AS x FROM a WHERE p % 10 = 0) SELECT name, count(*) - 1 AS size FROM a, f, (VALUES ('c0'), ('c1')) v(name) WHERE p / 10.0 BETWEEN x AND x + 1 GROUP BY name",
    "smooth_once": sql(["r0s"], f"SELECT site, k, {R('r', 'r')} FROM r0s"),
    "smooth_periodic": sql(["cw", "cls", "r0"], f", s AS (SELECT class AS other, k, sum(r) AS s FROM r0 JOIN cls USING (site) GROUP BY class, k) SELECT site, k, {R('sum(w * s)', 'r')} FROM cls JOIN cw USING (class) JOIN s USING (other) GROUP BY site, k"),
    "gmm_estep": sql(["rv"], f"SELECT site, k, {R('r', 'r')} FROM rv"),
    "gmm_mstep": sql([VEC1], PARAMS + VEC1),
    "gmm_loglik": sql(["rv"], "SELECT count(*) AS n, round(sum(lse), 4) AS ll FROM (SELECT DISTINCT site, any_value(lse) AS lse FROM rv GROUP BY site)"),
    "gmm_em3": sql([EM3], PARAMS + EM3),
    "gmm_stepwise3": sql([STEP3], PARAMS + STEP3),
    "gmm_smoothed2": sql(["sm2"], PARAMS + "sm2"),
    "gmm_periodic2": sql(["pq2"], PARAMS + "pq2"),
    "run_bundle": sql(["labels", "xm"], f"SELECT site, CAST(site // 50 AS INT) AS c0, CAST(site % 50 AS INT) AS c1, label, CAST(t + 1995 AS DOUBLE) AS at, {R('v', 'v')} FROM xm JOIN labels USING (site)"),
    "gmm_labels": sql(["labels"], "SELECT site, label FROM labels"),
    "cluster_sizes": sql(["labels", "p0"], "SELECT k AS label, count(site) AS n FROM (SELECT DISTINCT k FROM p0) LEFT JOIN labels ON label = k GROUP BY k"),
    "discovery_cluster": sql(["labels", EM3], f", sc AS (SELECT k, CASE WHEN (SELECT count(*) FROM labels WHERE label = k) >= 2 THEN stddev_pop(mu) ELSE 0 END AS sd FROM {EM3} GROUP BY k) SELECT k AS label FROM sc ORDER BY sd DESC, k LIMIT 1"),
    "second_pass_select": sql(["labels", EM3], f", sc AS (SELECT k, CASE WHEN (SELECT count(*) FROM labels WHERE label = k) >= 2 THEN stddev_pop(mu) ELSE 0 END AS sd FROM {EM3} GROUP BY k) SELECT site FROM labels WHERE label = (SELECT k FROM sc ORDER BY sd DESC, k LIMIT 1)"),
    "reorder_clusters": sql(
        ["labels", "cube", "p0"],
        """, lv AS (SELECT label, avg(v) AS level FROM cube JOIN labels USING (site) WHERE t < 1 GROUP BY label),
        mp AS (SELECT k, CAST(row_number() OVER (ORDER BY level DESC NULLS LAST, k) - 1 AS INT) AS nl FROM (SELECT DISTINCT k FROM p0) LEFT JOIN lv ON label = k) SELECT site, nl AS label FROM labels JOIN mp ON k = label""",
    ),
    "cluster_avg_intensity": sql(["labels", "cube"], f"SELECT label, t, {R('avg(v)', 'v')} FROM cube JOIN labels USING (site) GROUP BY label, t"),
    "trajectory_envelope": sql([EM3], f"SELECT k, t, {R('mu', 'mu')}, {R('mu - sqrt(var)', 'low')}, {R('mu + sqrt(var)', 'high')} FROM {EM3}"),
    "cluster_shifts": sql(["r0", "cube", "p0"], f", m AS (SELECT site, avg(v) AS m FROM cube GROUP BY site) SELECT k, {R('sum(r * m) / (count(*) * (SELECT any_value(w) FROM p0))', 'shift')} FROM r0 JOIN m USING (site) GROUP BY k"),
    "qmap_grid": sql(["labels"], "SELECT CAST(s // 50 AS INT) AS c0, CAST(s % 50 AS INT) AS c1, CAST(coalesce(label + 1, 0) AS INT) AS value FROM range(2500) g(s) LEFT JOIN labels ON site = s"),
    "zoom_view": sql(["labels"], "SELECT CAST(s // 50 AS INT) AS c0, CAST(s % 50 AS INT) AS c1, CAST(coalesce(label + 1, 0) AS INT) AS value FROM range(2500) g(s) LEFT JOIN labels ON site = s WHERE s // 50 BETWEEN 5 AND 24 AND s % 50 BETWEEN 0 AND 14"),
    "threshold_slice": sql(["skept"], "SELECT CAST(s // 400 AS INT) AS c0, CAST(s % 20 AS INT) AS c2, CAST(site IS NOT NULL AS INT) AS value FROM range(2800) g(s) LEFT JOIN skept ON site = s WHERE s // 20 % 20 = 4"),
    "plot_axes": """WITH a AS (SELECT CAST(max(l_partkey % 50) AS DOUBLE) / 10 AS high, CAST(min(l_partkey % 50) AS DOUBLE) / 10 AS low FROM lineitem)
        SELECT 'cut' AS role, 'L' AS name, 1996.0::DOUBLE AS low, 1996.0::DOUBLE AS high UNION ALL SELECT 'y', 'K', low, high FROM a UNION ALL SELECT 'x', 'H', low, high FROM a""",
    "threshold_space": sql(["skept"], f"SELECT site, {R('(site // 400) / 6', 'u0')}, {R('(site // 20 % 20) / 19', 'u1')}, {R('(site % 20) / 19', 'u2')} FROM skept"),
}


def drawn(site: str, seed: int, turn: int) -> str:
    """The draw of the operators, as an expression."""
    p = 2**31 - 1
    x = f"(({site} + {7919 * seed + 104_729 * turn}) % {p} + 1)"
    first = f"(({x} * 48271 % {p}) * ({x} * 48271 % {p}) % {p})"
    second = f"(({first} * {x} + 40692) % {p})"
    return f"((({second} * {second} % {p}) * 48271 + {x}) % {p})"


def first_sites(x: str, k: int) -> str:
    """Adds equal weights, the first k sites as means and the whole variance, as the start of a fit."""
    CTES[f"{x}_first"] = ([x], f"SELECT site, dense_rank() OVER (ORDER BY site) - 1 AS rk, t, v FROM {x}")
    CTES[f"{x}_var"] = ([x], f"SELECT t, greatest(var_pop(v), 1e-12) AS var FROM {x} GROUP BY t")
    CTES[f"{x}_b{k}"] = ([f"{x}_first", f"{x}_var"], f"SELECT CAST(rk AS INT) AS k, t, {1 / k!r} AS w, v AS mu, var FROM {x}_first JOIN {x}_var USING (t) WHERE rk < {k}")
    return f"{x}_b{k}"


def full_step(name: str, x: str, means: str, covs: str, n_t: int, reg: float) -> tuple[str, str]:
    """One EM step with full covariances: elimination of each matrix column by column, then the same on every site's deviation."""
    CTES[f"{name}_a0"] = ([covs], f"SELECT k, i, j, a + CASE WHEN i = j THEN 1e-6 ELSE 0 END AS a FROM {covs}")
    CTES[f"{name}_z0"] = ([x, means], f"SELECT site, k, t, w, v - mu AS z FROM {x} JOIN {means} USING (t)")
    for s in range(n_t - 1):
        CTES[f"{name}_l{s}"] = ([f"{name}_a{s}"], f"SELECT c.k, c.i, c.a / p.a AS l FROM {name}_a{s} c JOIN {name}_a{s} p ON p.k = c.k AND p.i = {s} AND p.j = {s} WHERE c.j = {s} AND c.i > {s}")
        CTES[f"{name}_a{s + 1}"] = (
            [f"{name}_l{s}"],
            f"SELECT m.k, m.i, m.j, CASE WHEN m.i > {s} THEN m.a - l.l * r.a ELSE m.a END AS a FROM {name}_a{s} m LEFT JOIN {name}_l{s} l ON l.k = m.k AND l.i = m.i JOIN {name}_a{s} r ON r.k = m.k AND r.i = {s} AND r.j = m.j",
        )
        CTES[f"{name}_z{s + 1}"] = (
            [f"{name}_z{s}", f"{name}_l{s}"],
            f"SELECT z.site, z.k, z.t, z.w, CASE WHEN z.t > {s} THEN z.z - l.l * h.z ELSE z.z END AS z FROM {name}_z{s} z LEFT JOIN {name}_l{s} l ON l.k = z.k AND l.i = z.t JOIN {name}_z{s} h ON h.site = z.site AND h.k = z.k AND h.t = {s}",
        )
    last = n_t - 1
    CTES[f"{name}_r_d"] = (
        [f"{name}_z{last}", f"{name}_a{last}"],
        f"SELECT site, z.k, any_value(w) AS w, -0.5 * ({n_t} * ln({2 * pi!r}) + sum(ln(a)) + sum(z * z / a)) AS ld FROM {name}_z{last} z JOIN {name}_a{last} p ON p.k = z.k AND p.i = z.t AND p.j = z.t GROUP BY site, z.k",
    )
    CTES[f"{name}_r_e"] = ([f"{name}_r_d"], f"SELECT site, k, w * exp(ld - max(ld) OVER (PARTITION BY site)) AS e FROM {name}_r_d")
    CTES[f"{name}_r"] = ([f"{name}_r_e"], f"SELECT site, k, e / greatest(sum(e) OVER (PARTITION BY site), 1e-300) AS r FROM {name}_r_e")
    CTES[f"{name}_m"] = ([x, f"{name}_r"], f"SELECT k, t, sum(r) / count(*) AS w, sum(r * v) / greatest(sum(r), count(*) * 1e-10) AS mu FROM {x} JOIN {name}_r USING (site) GROUP BY k, t")
    CTES[f"{name}_c"] = (
        [x, f"{name}_r", f"{name}_m"],
        f"""SELECT a.k, a.t AS i, b.t AS j, sum(a.r * a.e * b.e) / greatest(sum(a.r), count(*) * 1e-10) + CASE WHEN a.t = b.t THEN {reg!r} ELSE 0 END AS a
        FROM (SELECT site, k, t, r, v - mu AS e FROM {x} JOIN {name}_r USING (site) JOIN {name}_m USING (k, t)) a JOIN (SELECT site, k, t, v - mu AS e FROM {x} JOIN {name}_r USING (site) JOIN {name}_m USING (k, t)) b USING (site, k) GROUP BY a.k, a.t, b.t""",
    )
    return f"{name}_m", f"{name}_c"


CTES["f0c"] = (["p0"], "SELECT a.k, a.t AS i, b.t AS j, CASE WHEN a.t = b.t THEN a.var + 1e-6 ELSE 0 END AS a FROM p0 a JOIN p0 b USING (k)")
_FULL = full_step("f2", "xm", *full_step("f1", "xm", "p0", "f0c", 7, 1e-6), 7, 1e-6)
ORACLES["gmm_full_em2"] = sql([*_FULL], f"SELECT m.k, m.t, {R('w', 'w')}, {R('mu', 'mu')}, {R('greatest(a, 0)', 'var')} FROM {_FULL[0]} m JOIN {_FULL[1]} c ON c.k = m.k AND c.i = m.t AND c.j = m.t")

CTES["ohp"] = (
    ["olm"],
    """SELECT count(*) AS n, max(x) FILTER (k = CAST(round_even(c * 0.75, 0) AS BIGINT)) - max(x) FILTER (k = CAST(round_even(c * 0.25, 0) AS BIGINT)) AS iqr
    FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k, count(*) OVER () AS c FROM olm)""",
)
ORACLES["order_bin_width"] = sql(["ohp"], f"SELECT n, {R('iqr', 'iqr')}, {R('iqr / pow(n, 1.0 / 3)', 'width')} FROM ohp")
ORACLES["order_deciles"] = sql(["olm"], f"SELECT CAST(d AS INT) AS decile, {R('x', 'x')} FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k, count(*) OVER () AS c FROM olm), range(11) r(d) WHERE k = (c - 1) * d // 10")

# The field: blocks of 20 parts by weeks, seven line numbers.
CTES["ff"] = ([], "SELECT l_partkey // 20 AS a, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS days, l_linenumber % 7 AS t, l_quantity AS v FROM lineitem")
CTES["fdim"] = (["ff"], "SELECT max(days // 7) + 1 AS n1 FROM ff")
CTES["fq"] = (["ff", "fdim"], "SELECT CAST(a * n1 + days // 7 AS BIGINT) AS site, t, CAST(sum(v) AS DOUBLE) AS v FROM ff, fdim GROUP BY ALL")
CTES["fld"] = (["fq"], "SELECT p.site, CAST(z.t AS INT) AS t, coalesce(q.v, 0) AS v FROM (SELECT DISTINCT site FROM fq) p CROSS JOIN range(7) z(t) LEFT JOIN fq q ON q.site = p.site AND q.t = z.t")
CTES["flm"] = (["fld"], "SELECT site, ln(sum(v) / 7) AS x FROM fld GROUP BY site HAVING sum(v) > 0")
CTES["fkept"] = (["flm"], "SELECT site FROM flm WHERE x > (SELECT avg(x) + 0.5 * stddev_pop(x) FROM flm)")
CTES["fxm"] = (["fld", "fkept"], "SELECT site, t, v / nullif(avg(v) OVER (PARTITION BY site), 0) - 1 AS v FROM fld JOIN fkept USING (site)")
CTES["freach"] = (
    ["fkept", "fdim"],
    """SELECT a.site AS i, b.site AS j, dx, dy FROM fkept a, fdim, (SELECT x - 2 AS dx FROM range(5) r(x)), (SELECT y - 2 AS dy FROM range(5) r(y)), fkept b
    WHERE b.site = a.site + dx * n1 + dy AND a.site % n1 + dy BETWEEN 0 AND n1 - 1""",
)
CTES["fcomp"] = (["freach"], "SELECT i AS site, i AS root FROM freach WHERE i = j UNION SELECT r.j, c.root FROM fcomp c JOIN freach r ON r.i = c.site AND abs(dx) <= 1 AND abs(dy) <= 1")
CTES["fpeaks"] = (["fcomp"], "SELECT site, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS peak FROM (SELECT site, min(root) AS root FROM fcomp GROUP BY site)")
CTES["fnear"] = (["freach"], f"SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM freach WHERE dx * dx + dy * dy < {log(100)!r}")
ORACLES["field_kept"] = sql(["fkept"], "SELECT site FROM fkept")
ORACLES["field_peaks"] = sql(["fpeaks"], "SELECT site, peak FROM fpeaks")
ORACLES["field_peak_trajectories"] = sql(["fpeaks", "fld"], f"SELECT peak, t, {R('avg(v)', 'v_mean')}, max(v) AS v_max FROM fld JOIN fpeaks USING (site) GROUP BY peak, t")
responsibilities("fr0", "fxm", first_sites("fxm", 3))
CTES["fr0s"] = (["fnear", "fr0"], "SELECT i AS site, k, sum(w * r) AS r FROM fnear JOIN fr0 ON fr0.site = fnear.j GROUP BY i, k")
ORACLES["field_smooth"] = sql(["fr0s"], f"SELECT site, k, {R('r', 'r')} FROM fr0s")
ORACLES["field_smoothed_step"] = sql([maximised("fsm", "fxm", "fr0s", "fxm_b3", step_size(0))], PARAMS + "fsm")

ORDER2 = steps("oem", "oxm", first_sites("oxm", 3), [1.0] * 2, 1e-6)
ORACLES["gmm_order2"] = sql([ORDER2], PARAMS + ORDER2)

responsibilities("shr", "shx", steps("she", "shx", first_sites("shx", 3), [1.0] * 2, 1e-6))
CTES["shl"] = (["shr"], "SELECT site, CAST(arg_min(k, (-r, k)) AS INT) AS label FROM shr GROUP BY site")
ORACLES["kspace_slice"] = sql(
    ["shl", "skept"],
    "SELECT CAST(s // 20 % 20 AS INT) AS c1, CAST(s % 20 AS INT) AS c2, CAST(CASE WHEN label IS NOT NULL THEN label + 2 WHEN skept.site IS NOT NULL THEN 1 ELSE 0 END AS INT) AS value FROM range(2800) g(s) LEFT JOIN shl p ON p.site = s LEFT JOIN skept ON skept.site = s WHERE s // 400 = 3",
)
ORACLES["clusters_space"] = sql(
    ["shl", "svar"],
    f"SELECT v.site, CAST(CASE WHEN high THEN label + 1 ELSE 0 END AS INT) AS \"group\", {R('(v.site // 400) / 6', 'u0')}, {R('(v.site // 20 % 20) / 19', 'u1')}, {R('(v.site % 20) / 19', 'u2')} FROM svar v LEFT JOIN shl l ON l.site = v.site",
)

_REFINED = steps("rf", "xm", "p0", [1.0] * 5, 1e-6)
for _k in range(2):
    _REFINED = maximised(f"rg{_k}", "xm", responsibilities(f"rg{_k}r", "xm", _REFINED), _REFINED, step_size(_k))
ORACLES["post_stepwise_refine"] = sql([_REFINED], PARAMS + _REFINED)

_LAST = _P = "p0"
for _k in range(7):  # three rounds of three mini-batches, then four full passes; labels follow the last pass's E-step
    for _b in range(3) if _k < 3 else [None]:
        _X, _LAST = "xm", _P
        if _b is not None:
            _X = f"xm_{_k}{_b}"
            CTES[_X] = (["xm"], f"SELECT * FROM xm WHERE {drawn('(' + drawn('site', 0, 10_000) + ' % 64)', 0, _k)} % 3 = {_b}")
        _R = responsibilities(f"mb{_k}{_b}r", _X, _P)
        _P = maximised(f"mb{_k}{_b}", _X, _R, _P, step_size(_k))
responsibilities("mbl", "xm", _LAST)
ORACLES["minibatch_stepwise"] = sql(["mbl", "p0"], "SELECT k AS label, count(site) AS n FROM (SELECT unnest(range(3)) AS k) LEFT JOIN (SELECT site, arg_min(k, (-r, k)) AS label FROM mbl GROUP BY site) ON label = k GROUP BY k".replace("SELECT k AS label", "SELECT CAST(k AS INT) AS label"))


def _bic(x: str, k_range: range, n_t: int) -> str:
    """Two batch passes for each k from the first vectors, in SQL."""
    rows = []
    for k in k_range:
        last = steps(f"{x}_f{k}_", x, first_sites(x, k), [1.0] * 2, 1e-6)
        responsibilities(f"{x}_r{k}", x, last)
        rows.append((k, 2 * k * n_t + k - 1))
    return " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS k, ll, -2 * ll + {p} * ln(n) AS bic FROM (SELECT sum(lse) AS ll, count(*) AS n FROM {x}_r{k} WHERE k = 0)" for k, p in rows)


_VEC_BIC = _bic("vec", range(2, 5), 64)
ORACLES["bic_table"] = sql([f"vec_r{k}" for k in range(2, 5)], f"SELECT k, round(ll, 3) AS ll, round(bic, 3) AS bic FROM ({_VEC_BIC})")
ORACLES["best_k"] = sql([f"vec_r{k}" for k in range(2, 5)], f"SELECT k, round(bic, 3) AS bic FROM ({_VEC_BIC}) ORDER BY bic, k LIMIT 1")
ORACLES["bic_saved"] = ORACLES["bic_table"]
_BOTH = {m: (_bic(x, range(2, 5), 7), [f"{x}_r{k}" for k in range(2, 5)]) for m, x in (("d", "xm"), ("s", "pxm"))}
ORACLES["recommend_mode"] = sql(
    _BOTH["d"][1] + _BOTH["s"][1],
    f""", d AS (SELECT k, bic FROM ({_BOTH["d"][0]}) ORDER BY bic, k LIMIT 1), s AS (SELECT k, bic FROM ({_BOTH["s"][0]}) ORDER BY bic, k LIMIT 1)
    SELECT CASE WHEN s.bic < d.bic THEN 's' ELSE 'd' END AS mode, CASE WHEN s.bic < d.bic THEN s.k ELSE d.k END AS k, round(d.bic, 3) AS bic_d, round(s.bic, 3) AS bic_s FROM d, s""",
)

def seeded(name: str, x: str, k: int) -> str:
    """Adds the first k planted kinds as means, with equal weights and x's variance."""
    CTES[name] = (["xm", x], f"SELECT CAST(b.site // 10 AS INT) AS k, b.t, {1 / k!r} AS w, b.v AS mu, greatest(s.var, 1e-12) AS var FROM xm b JOIN (SELECT t, var_pop(v) AS var FROM {x} GROUP BY t) s USING (t) WHERE b.site IN ({', '.join(str(10 * j) for j in range(k))})")
    return name


def labelled(name: str, x: str, p: str) -> str:
    responsibilities(f"{name}_r", x, p)
    CTES[name] = ([f"{name}_r"], f"SELECT site, CAST(arg_min(k, (-r, k)) AS INT) AS label FROM {name}_r GROUP BY site")
    return name


def reordered(name: str, labels: str, raw: str, k: int) -> str:
    """Adds label -> new label by the mean of raw (site, t, v) at the first value of the axis, brightest first."""
    CTES[name] = (
        [labels, raw],
        f"""SELECT CAST(g.k AS INT) AS k, CAST(row_number() OVER (ORDER BY level DESC NULLS LAST, g.k) - 1 AS INT) AS nl FROM range({k}) g(k)
        LEFT JOIN (SELECT label, avg(v) AS level FROM {raw} JOIN {labels} USING (site) WHERE t < 1 GROUP BY label) ON label = g.k""",
    )
    return name


PASSES = 30
_DIRECT = labelled("jdl", "xm", steps("jd", "xm", "p0", [1.0] * PASSES, 1e-6))
ORACLES["job_direct"] = sql([_DIRECT, reordered("jdo", _DIRECT, "cube", 3)], "SELECT site, nl AS label FROM jdl JOIN jdo ON k = label")
CTES["praw"] = (["peaks", "cube"], "SELECT peak AS site, t, avg(v) AS v FROM cube JOIN peaks USING (site) GROUP BY peak, t")
_PEAKED = labelled("jsl", "pxm", steps("js", "pxm", seeded("ps0", "pxm", 3), [1.0] * PASSES, 1e-6))
ORACLES["job_peaks"] = sql([_PEAKED, reordered("jso", _PEAKED, "praw", 3), "peaks"], "SELECT peaks.site, nl AS label FROM peaks JOIN jsl ON jsl.site = peak JOIN jso ON k = label")
CTES["x2"] = (["xm", _DIRECT], "SELECT site, t, v FROM xm JOIN jdl USING (site) WHERE label = 0")
_SECOND = labelled("j2l", "x2", steps("j2", "x2", seeded("p20", "x2", 2), [1.0] * 5, 1e-6))
ORACLES["job_two_pass"] = sql([_DIRECT, _SECOND], "SELECT a.site, a.label AS first, b.label AS second FROM jdl a LEFT JOIN j2l b ON b.site = a.site")
_P = steps("jm", "xm", "p0", [1.0] * 3, 1e-6)
for _k in range(3):
    responsibilities(f"jm_r{_k}", "xm", _P)
    CTES[f"jm_s{_k}"] = (["near", f"jm_r{_k}"], f"SELECT i AS site, k, sum(w * r) AS r FROM near JOIN jm_r{_k} x ON x.site = near.j GROUP BY i, k")
    _P = maximised(f"jm_p{_k}", "xm", f"jm_s{_k}", _P, step_size(_k))
CTES["jml"] = (["jm_s2"], "SELECT site, CAST(arg_min(k, (-r, k)) AS INT) AS label FROM jm_s2 GROUP BY site")
ORACLES["job_smoothed"] = sql([_P, reordered("jmo", "jml", "cube", 3)], f"SELECT nl AS k, t, {R('w', 'w')}, {R('mu', 'mu')}, {R('var', 'var')} FROM {_P} JOIN jmo USING (k)")

_ROWS, _NEED = [], []
for _m, _x in (("d", "xm"), ("s", "pxm")):
    for _k in (2, 3):
        _last = steps(f"jw{_m}{_k}", _x, seeded(f"jw{_m}{_k}s", _x, _k), [1.0] * 10, 1e-6)
        labelled(f"jw{_m}{_k}l", _x, _last)
        _NEED += [f"jw{_m}{_k}l"]
        _ROWS.append(f"SELECT '{_m}' AS mode, CAST({_k} AS INT) AS k, round(-2 * ll + {2 * _k * 7 + _k - 1} * ln(n), 3) AS bic, (SELECT count(DISTINCT label) FROM jw{_m}{_k}l) AS n FROM (SELECT sum(lse) AS ll, count(*) AS n FROM jw{_m}{_k}l_r WHERE k = 0)")
ORACLES["job_workflow"] = sql(
    _NEED,
    f", c AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY bic, k) AS rk FROM ({' UNION ALL '.join(_ROWS)})), w AS (SELECT mode, k FROM c WHERE rk = 1 ORDER BY bic, mode LIMIT 1) "
    "SELECT c.mode, c.k, bic, CAST(CASE WHEN w.mode IS NOT NULL THEN n END AS INT) AS n_clusters FROM c LEFT JOIN w ON w.mode = c.mode AND w.k = c.k",
)
ORACLES["job_converged"] = sql(["kept"], "SELECT count(*) AS n, true AS converged, CAST(0 AS INT) AS falls FROM kept")

for _k in range(4):  # k-means++: each pick is the least exponential, at the rate of the distance to the nearest pick so far
    _gaps = " UNION ALL ".join(f"SELECT a.site, sum((a.v - b.v) * (a.v - b.v)) AS gap FROM vec a JOIN vec b USING (t) JOIN pick{j} p ON b.site = p.site GROUP BY a.site" for j in range(_k)) or "SELECT DISTINCT site, CAST(1 AS DOUBLE) AS gap FROM vec"
    _done = " AND ".join(f"site <> (SELECT site FROM pick{j})" for j in range(_k)) or "true"
    CTES[f"pick{_k}"] = (
        ["vec", *[f"pick{j}" for j in range(_k)]],
        f"""SELECT site FROM (SELECT site, min(gap) AS gap, any_value(({drawn("site", 0, _k)} + 1) / CAST({2**31} AS DOUBLE)) AS u FROM ({_gaps}) GROUP BY site) WHERE {_done}
        ORDER BY gap > 0 DESC, CASE WHEN gap > 0 THEN -ln(u) / gap ELSE u END, site LIMIT 1""",
    )
ORACLES["kmeanspp_init"] = sql(["vec", *[f"pick{k}" for k in range(4)]], " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS k, t, {R('v', 'mu')} FROM vec JOIN pick{k} USING (site)" for k in range(4)))
_U = "({0} + 1) / CAST(2147483648 AS DOUBLE)".format
CTES["kc0"] = (["vec"], f"SELECT CAST(0 AS BIGINT) AS turn, site FROM (SELECT DISTINCT site FROM vec) ORDER BY {drawn('site', 0, 0)}, site LIMIT 1")
for _k in (1, 2):  # k-means||: rounds of oversampling
    CTES[f"kd{_k}"] = (["vec", f"kc{_k - 1}"], f"SELECT site, min(gap) AS gap FROM (SELECT a.site, c.site AS c, sum((a.v - b.v) * (a.v - b.v)) AS gap FROM vec a JOIN vec b USING (t) JOIN kc{_k - 1} c ON b.site = c.site GROUP BY a.site, c.site, c.turn) GROUP BY site")
    CTES[f"kc{_k}"] = ([f"kd{_k}", f"kc{_k - 1}"], f"SELECT * FROM kc{_k - 1} UNION ALL SELECT {_k}, site FROM kd{_k} WHERE {_U(drawn('site', 0, _k))} * (SELECT sum(gap) FROM kd{_k}) < 8 * gap")
CTES["kcand"] = (["kc2"], "SELECT row_number() OVER (ORDER BY turn, site) - 1 AS c, site FROM kc2")
CTES["kcv"] = (["kcand", "vec"], "SELECT c, t, v FROM kcand JOIN vec USING (site)")
CTES["kw"] = (["kcv", "vec"], "SELECT c, count(*) AS w FROM (SELECT site, arg_min(c, (gap, c)) AS c FROM (SELECT site, c, sum((a.v - b.v) * (a.v - b.v)) AS gap FROM vec a JOIN kcv b USING (t) GROUP BY site, c) GROUP BY site) GROUP BY c")
CTES["kp0"] = (["kw"], "SELECT c FROM kw ORDER BY w DESC, c LIMIT 1")
for _k in range(1, 4):  # and the weighted draw among the candidates
    _gaps = " UNION ALL ".join(f"SELECT a.c, sum((a.v - b.v) * (a.v - b.v)) AS gap FROM kcv a JOIN kcv b USING (t) JOIN kp{j} p ON b.c = p.c GROUP BY a.c" for j in range(_k))
    CTES[f"kp{_k}"] = (
        ["kcv", "kw", *[f"kp{j}" for j in range(_k)]],
        f"SELECT c FROM (SELECT c, min(gap) * coalesce(any_value(w), 0) AS far FROM ({_gaps}) LEFT JOIN kw USING (c) GROUP BY c) WHERE far > 0 ORDER BY -ln({_U(drawn('c', 0, 1000 + _k))}) / far, c LIMIT 1",
    )
CTES["km0"] = (["kcv", *[f"kp{k}" for k in range(4)]], " UNION ALL ".join(f"SELECT {k} AS k, t, v AS mu FROM kcv JOIN kp{k} USING (c)" for k in range(4)))
for _k in range(4):
    CTES[f"ka{_k}"] = (["vec", f"km{_k}"], f"SELECT site, arg_min(k, (gap, k)) AS k FROM (SELECT site, k, sum((v - mu) * (v - mu)) AS gap FROM vec JOIN km{_k} USING (t) GROUP BY site, k) GROUP BY site")
    CTES[f"km{_k + 1}"] = ([f"ka{_k}", f"km{_k}", "vec"], f"SELECT o.k, o.t, coalesce(m, mu) AS mu FROM km{_k} o LEFT JOIN (SELECT k, t, avg(v) AS m FROM vec JOIN ka{_k} USING (site) GROUP BY k, t) USING (k, t)")
ORACLES["kmeans_init"] = sql(["km4"], f"SELECT CAST(k AS INT) AS k, t, {R('mu', 'mu')} FROM km4")
ORACLES["rescale_none"] = sql(["kc"], f"SELECT site, t, {R('v', 'v')} FROM kc")
ORACLES["results_saved"] = sql(["labels", EM3], f"SELECT k, t, {R('mu', 'mu')}, {R('var', 'var')}, (SELECT count(*) FROM labels WHERE label = k) AS n FROM {EM3}")
ORACLES["event_windows"] = f"SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS day, CAST(user_id % 10 AS INT) AS c0, CAST(user_id // 10 AS INT) AS c1, {R('sum(value)', 'v')} FROM events GROUP BY ALL"
ORACLES["workflow_report"] = sql(
    [f"vec_r{k}" for k in range(2, 5)],
    f""", b AS (SELECT k, round(ll, 3) AS ll, round(bic, 3) AS bic FROM ({_VEC_BIC}))
    SELECT '{{"rescale":"mean","threshold":"simple"}}' AS settings, '[' || string_agg('{{"k":' || k || ',"ll":' || ll || ',"bic":' || bic || '}}', ',' ORDER BY k) || ']' AS sweep,
    '{{"mode":"d","k":"' || arg_min(k, (bic, k)) || '"}}' AS choice FROM b""",
)
ORACLES["gaussian_init"] = sql(
    ["vec"],
    f""", m AS (SELECT t, avg(v) AS m, var_pop(v) AS s FROM vec GROUP BY t), u AS (SELECT CAST(c AS INT) AS k, t, m, s, ({drawn("(c * 64 + t)", 0, 0)} + 1) / CAST({2**31} AS DOUBLE) AS a, ({drawn("(c * 64 + t)", 0, 1)} + 1) / CAST({2**31} AS DOUBLE) AS b FROM m, range(4) r(c))
    SELECT k, t, {R(f"m + sqrt(-2 * ln(a)) * cos({2 * pi!r} * b) * sqrt(s)", "mu")} FROM u""",
)
