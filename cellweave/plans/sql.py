"""SQL texts that state the catalogue's queries a second time."""

X = """WITH X AS (SELECT l_suppkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
T AS (SELECT cell, sum(value) AS n_counts FROM X GROUP BY cell),
M AS (SELECT median(n_counts) AS med FROM T),
N AS (SELECT X.cell, gene, ln(1 + value * (med / n_counts)) AS value FROM X JOIN T USING (cell), M)
"""

FILTERED = """WITH C AS (SELECT l_orderkey AS cell, l_linenumber::BIGINT AS gene, sum(round(l_discount * 100)) AS value
FROM lineitem GROUP BY ALL),
G AS (SELECT * FROM C WHERE gene IN (SELECT gene FROM C GROUP BY gene HAVING sum(value) >= 1))
SELECT cell, gene, value FROM G WHERE cell IN (SELECT cell FROM G GROUP BY cell HAVING sum(value) >= 1)"""

GRID = X.rstrip() + """,
G AS (SELECT c.cell, g.gene, coalesce(N.value, 0) AS value FROM (SELECT DISTINCT cell FROM X) c
CROSS JOIN (SELECT DISTINCT gene FROM X) g LEFT JOIN N ON N.cell = c.cell AND N.gene = g.gene)
"""

SCALED = GRID.rstrip() + """,
H AS (SELECT gene, avg(value) AS m, stddev_samp(value) AS s FROM G GROUP BY gene)
SELECT cell, gene, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS z FROM G JOIN H USING (gene)"""

SCALED_SILHOUETTE = f"""WITH P AS (SELECT cell AS id, any_value(s_nationkey) AS label, list(z ORDER BY gene) AS z FROM ({SCALED})
JOIN supplier ON s_suppkey = cell GROUP BY cell)
, BOTH_ AS (SELECT a.id AS i, a.label AS li, b.label AS lj, list_distance(a.z, b.z) AS d FROM P a CROSS JOIN P b),
A AS (SELECT i, li, lj, sum(d) AS s, count(*) AS n FROM BOTH_ GROUP BY ALL),
B AS (SELECT i, max(CASE WHEN li = lj AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN s / n END) AS b FROM A GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS sil FROM B"""

STATS = GRID.rstrip() + """,
V AS (SELECT gene, avg(value) AS mean, var_pop(value) AS var_pop FROM G GROUP BY gene)
"""

# the trend fitted in SQL: n and b (its logarithm) by Gauss-Newton on the curve with a at its best, from the best of a grid
TREND = STATS.replace("WITH", "WITH RECURSIVE", 1).rstrip() + """,
D AS MATERIALIZED (SELECT mean::DOUBLE AS m, ln(mean)::DOUBLE AS l, var_pop::DOUBLE AS v FROM V WHERE mean > 0),
START AS (SELECT n, b FROM (SELECT 1::DOUBLE AS n, 0::DOUBLE AS b UNION ALL
  SELECT n, n * (SELECT avg(l) FROM D) + o FROM (SELECT unnest([-8, -4, -2, -1, 0.5, 1, 2, 4, 8, 16])::DOUBLE AS n), (SELECT unnest([-9, -6, -3, -1, 0, 1, 3, 6, 9])::DOUBLE AS o)), D
  GROUP BY n, b ORDER BY sum(v * v) - sum(v * m / (exp(n * l) + exp(b))) ^ 2 / sum((m / (exp(n * l) + exp(b))) ^ 2) LIMIT 1),
FIT(k, n, b) AS (SELECT 0, n, b FROM START UNION ALL
  SELECT k + 1, n + (hb * sn - h * sb) / (ha * hb - h * h), b + (ha * sb - h * sn) / (ha * hb - h * h)
  FROM (SELECT k, n, b, (1 + d) * s * s * (nn - ng * ng / gg) AS ha, (1 + d) * s * s * (bb - bg * bg / gg) AS hb, s * s * (nb - ng * bg / gg) AS h,
               s * (vn - s * ng) AS sn, s * (vb - s * bg) AS sb
        FROM (SELECT *, vg / gg AS s, CASE WHEN k < 20 THEN 0.3 ELSE 1e-6 END AS d
              FROM (SELECT k, n, b, sum(v * g) AS vg, sum(g * g) AS gg, sum(v * dn) AS vn, sum(v * db) AS vb, sum(g * dn) AS ng, sum(g * db) AS bg,
                           sum(dn * dn) AS nn, sum(db * db) AS bb, sum(dn * db) AS nb
                    FROM (SELECT k, n, b, v, m / (exp(n * l) + exp(b)) AS g, -m * l * exp(n * l) / (exp(n * l) + exp(b)) ^ 2 AS dn,
                                 -m * exp(b) / (exp(n * l) + exp(b)) ^ 2 AS db FROM FIT, D) GROUP BY k, n, b))) WHERE k < 80),
LAST AS (SELECT n, b, sum(v * m / (exp(n * l) + exp(b))) / sum((m / (exp(n * l) + exp(b))) ^ 2) AS a FROM FIT, D WHERE k = 80 GROUP BY n, b)
"""

PEARSON = X.rstrip() + """,
C AS (SELECT cell, sum(value) AS s1, sum(value * value) AS s2 FROM N GROUP BY cell),
K AS (SELECT count(DISTINCT gene)::DOUBLE AS n FROM N),
P AS (SELECT a.cell AS i, b.cell AS j, sum(a.value * b.value) AS xy FROM N a JOIN N b ON a.gene = b.gene AND a.cell < b.cell
GROUP BY ALL),
S AS (SELECT a.cell AS i, b.cell AS j, round((n * coalesce(xy, 0) - a.s1 * b.s1)
/ nullif(sqrt((n * a.s2 - a.s1 * a.s1) * (n * b.s2 - b.s1 * b.s1)), 0), 12) AS r
FROM C a JOIN C b ON a.cell < b.cell CROSS JOIN K LEFT JOIN P ON P.i = a.cell AND P.j = b.cell)
"""

# means from a fold that truncates after every addition, genes in order
UNION_PEARSON = X.rstrip() + """,
C AS (SELECT cell, sum(value) AS s1, sum(value * value) AS s2, count(*) AS n,
list_reduce(list_prepend(0.0, list(value ORDER BY gene)), lambda acc, x: trunc(acc + x)) AS w FROM N GROUP BY cell),
P AS (SELECT a.cell AS i, b.cell AS j, sum(a.value * b.value) AS xy, count(*) AS shared
FROM N a JOIN N b ON a.gene = b.gene AND a.cell < b.cell GROUP BY ALL),
U AS (SELECT a.cell AS i, b.cell AS j, coalesce(xy, 0) AS xy, a.s1 AS a1, a.s2 AS a2, b.s1 AS b1, b.s2 AS b2,
(a.n + b.n - coalesce(shared, 0))::DOUBLE AS n, a.w AS aw, b.w AS bw
FROM C a JOIN C b ON a.cell < b.cell LEFT JOIN P ON P.i = a.cell AND P.j = b.cell),
R AS (SELECT i, j, xy - bw / n * a1 - aw / n * b1 + n * (aw / n) * (bw / n) AS cov,
a2 - 2 * (aw / n) * a1 + n * (aw / n) ^ 2 AS va, b2 - 2 * (bw / n) * b1 + n * (bw / n) ^ 2 AS vb FROM U)
SELECT i, j, round(cov / nullif(sqrt(va * vb), 0), 6) + 0.0 AS r FROM R"""

JACCARD = X.rstrip() + """,
A AS (SELECT * FROM X WHERE value >= 30),
C AS (SELECT c.cell, count(A.cell) AS n FROM (SELECT s_suppkey AS cell FROM supplier) c LEFT JOIN A ON A.cell = c.cell GROUP BY c.cell),
P AS (SELECT a.cell AS i, b.cell AS j, count(*) AS shared FROM A a JOIN A b ON a.gene = b.gene AND a.cell < b.cell GROUP BY ALL)
SELECT a.cell AS i, b.cell AS j, round(coalesce(shared, 0) / nullif(a.n + b.n - coalesce(shared, 0), 0), 6) AS jaccard
FROM C a JOIN C b ON a.cell < b.cell LEFT JOIN P ON P.i = a.cell AND P.j = b.cell"""

KNN = PEARSON.rstrip() + """,
W AS (SELECT i, j, r FROM S UNION ALL SELECT j, i, r FROM S),
O AS (SELECT i, j, r, row_number() OVER (PARTITION BY i ORDER BY trunc(round(r * 10000, 6)) DESC, j) AS rn FROM W WHERE r IS NOT NULL)
SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, trunc(round(r * 1000, 6)) + 0.0 AS weight FROM O
WHERE rn <= (SELECT trunc(ln(count(*))) FROM C)"""


def kmst(rounds: str) -> str:
    """Edges in (cost, i, j) order, each put in the first forest where it closes no cycle."""
    head = PEARSON.replace("WITH X", "WITH RECURSIVE X", 1).rstrip()
    return head + f""",
I AS (SELECT cell, (row_number() OVER (ORDER BY cell) - 1)::INTEGER AS ix FROM C),
Z AS (SELECT count(*)::INTEGER AS n, CAST({rounds} AS INTEGER) AS k FROM (SELECT count(*) AS n FROM C), C GROUP BY {rounds}),
E AS (SELECT row_number() OVER (ORDER BY 1 - r, i, j) AS rk, i, j, 1 - r AS cost, a.ix AS u, b.ix AS v
FROM S JOIN I a ON a.cell = S.i JOIN I b ON b.cell = S.j WHERE r > 0),
L(rk, comp, f) AS (
SELECT 0::BIGINT, list_transform(range(k * n), lambda x: (x % n)::INTEGER), 0 FROM Z
UNION ALL
SELECT rk, CASE WHEN f = 0 THEN comp ELSE list_transform(comp, lambda x, ix:
CASE WHEN ix > (f - 1) * n AND ix <= f * n AND x = comp[(f - 1) * n + v + 1] THEN comp[(f - 1) * n + u + 1] ELSE x END) END, f
FROM (SELECT E.rk, L.comp, E.u, E.v, Z.n, coalesce(list_min(list_filter(range(1, Z.k + 1), lambda t:
L.comp[(t - 1) * Z.n + E.u + 1] <> L.comp[(t - 1) * Z.n + E.v + 1])), 0)::INTEGER AS f
FROM L JOIN E ON E.rk = L.rk + 1 CROSS JOIN Z)),
F AS (SELECT E.i, E.j, E.cost, L.f FROM L JOIN E USING (rk) WHERE f > 0)
"""


def components(threshold: float) -> str:
    head = PEARSON.replace("WITH X", "WITH RECURSIVE X", 1).rstrip()
    return head + f""",
W AS (SELECT i AS u, j AS v FROM S WHERE r > {threshold} UNION SELECT j, i FROM S WHERE r > {threshold}),
R(u, v) AS (SELECT cell, cell FROM C UNION SELECT R.u, W.v FROM R JOIN W ON W.u = R.v)
SELECT u AS cell, dense_rank() OVER (ORDER BY least_cell) - 1 AS component FROM (SELECT u, min(v) AS least_cell FROM R GROUP BY u)"""


_ENDS = """SELECT a.s_nationkey::BIGINT AS ci, b.s_nationkey::BIGINT AS cj, cost FROM F
JOIN supplier a ON a.s_suppkey = F.i JOIN supplier b ON b.s_suppkey = F.j"""


def modularity(gamma: float) -> str:
    return f"""SELECT round((SELECT coalesce(sum(cost) FILTER (ci = cj), 0) / sum(cost) FROM ({_ENDS})) - {gamma} *
(SELECT sum((d / (2 * (SELECT sum(cost) FROM F))) ^ 2) FROM (SELECT c, sum(cost) AS d FROM
(SELECT ci AS c, cost FROM ({_ENDS}) UNION ALL SELECT cj, cost FROM ({_ENDS})) GROUP BY c)), 6) + 0.0 AS q"""


CONTRACTED = f"""SELECT least(ci, cj) AS ci, greatest(ci, cj) AS cj, round(sum(cost), 6) AS weight FROM ({_ENDS}) e
GROUP BY least(e.ci, e.cj), greatest(e.ci, e.cj)"""

ATLAS = """WITH L AS (SELECT o_custkey, o_orderstatus, p_name, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey),
AM AS (SELECT r_name AS tissue, c_mktsegment AS type, o_orderstatus AS cluster, p_name AS symbol, avg(l_quantity) AS mean
FROM L JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL),
PR AS (SELECT tissue, type, cluster, row_number() OVER (ORDER BY tissue, type, cluster) AS pid FROM (SELECT DISTINCT tissue, type, cluster FROM AM)),
SG AS (SELECT symbol FROM AM GROUP BY symbol HAVING count(*) = (SELECT count(*) FROM PR) INTERSECT SELECT p_name FROM part),
G AS (SELECT count(*)::DOUBLE AS n FROM SG),
E AS (SELECT o_custkey AS cell, p_name AS symbol, sum(l_quantity) AS value FROM L WHERE p_name IN (SELECT symbol FROM SG) GROUP BY ALL),
CE AS (SELECT c.cell, coalesce(sum(value), 0) AS s1, coalesce(sum(value * value), 0) AS s2 FROM (SELECT DISTINCT o_custkey AS cell FROM L) c LEFT JOIN E USING (cell) GROUP BY c.cell),
B AS (SELECT pid, symbol, mean AS value FROM AM JOIN PR USING (tissue, type, cluster) WHERE symbol IN (SELECT symbol FROM SG)),
BE AS (SELECT PR.pid, coalesce(sum(value), 0) AS s1, coalesce(sum(value * value), 0) AS s2 FROM PR LEFT JOIN B ON B.pid = PR.pid GROUP BY PR.pid),
XY AS (SELECT cell, pid, sum(E.value * B.value) AS xy FROM E JOIN B USING (symbol) GROUP BY ALL),
CR AS (SELECT c.cell, b.pid, tissue, type, cluster, round((n * coalesce(xy, 0) - c.s1 * b.s1)
/ nullif(sqrt((n * c.s2 - c.s1 * c.s1) * (n * b.s2 - b.s1 * b.s1)), 0), 12) AS r
FROM CE c CROSS JOIN BE b CROSS JOIN G JOIN PR ON PR.pid = b.pid LEFT JOIN XY ON XY.cell = c.cell AND XY.pid = b.pid),
AN AS (SELECT cell, CASE WHEN r IS NOT NULL THEN tissue END AS tissue, CASE WHEN r IS NOT NULL THEN type END AS type, r FROM
(SELECT *, row_number() OVER (PARTITION BY cell ORDER BY r DESC NULLS LAST, pid) AS rn FROM CR) WHERE rn = 1)
"""

NMI = """WITH ct AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL),
tot AS (SELECT sum(n)::DOUBLE AS t FROM ct), ra AS (SELECT a, sum(n) AS na FROM ct GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM ct GROUP BY b),
nmi AS (SELECT (SELECT sum(n / t * ln(n * t / (na * nb))) FROM ct JOIN ra USING (a) JOIN rb USING (b), tot)
/ (((SELECT -sum(na / t * ln(na / t)) FROM ra, tot) + (SELECT -sum(nb / t * ln(nb / t)) FROM rb, tot)) / 2) AS v)
"""

ARI = """WITH ct2 AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL),
parts AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct2) AS s,
(SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n)::DOUBLE AS m FROM ct2 GROUP BY a)) AS sa,
(SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n)::DOUBLE AS m FROM ct2 GROUP BY b)) AS sb,
(SELECT sum(n)::DOUBLE * (sum(n) - 1) / 2 FROM ct2) AS st),
ari AS (SELECT (s - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st) AS v FROM parts)
"""

POINTS = """WITH P AS (SELECT vec_id AS id, embedding::DOUBLE[] AS z, label::BIGINT AS label FROM embeddings),
D AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, list_distance(a.z, b.z) AS d FROM P a JOIN P b ON a.id < b.id
WHERE list_distance(a.z, b.z) > 0),
U AS (SELECT id, label, unnest(z) AS x, generate_subscripts(z, 1) AS pos FROM P),
CM AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM U GROUP BY ALL),
CN AS (SELECT label AS cluster, list(m ORDER BY pos) AS mu, max(n) AS n FROM CM GROUP BY label),
D2 AS (SELECT id, cluster, label, list_distance(z, mu) ^ 2 AS d2 FROM P CROSS JOIN CN),
NEAR AS (SELECT id, any_value(label) AS label, arg_min(cluster, d2) AS near FROM D2 GROUP BY id),
KS AS (SELECT id, cluster, 1 / (1 + d2) AS k FROM D2),
QS AS (SELECT id, cluster, k / sum(k) OVER (PARTITION BY id) AS q FROM KS),
SH AS (SELECT id, cluster, q * q / sum(q) OVER (PARTITION BY cluster) AS s FROM QS),
PS AS (SELECT id, cluster, s / sum(s) OVER (PARTITION BY id) AS p FROM SH),
WT AS (SELECT cluster, exp(cluster / 10) / sum(exp(cluster / 10)) OVER () AS w FROM CN),
DN AS (SELECT id, cluster, exp((min(d2) OVER (PARTITION BY id) - d2) / 2) AS e FROM D2),
GM AS (SELECT id, cluster, greatest(e / sum(e) OVER (PARTITION BY id) * w, 1e-10) AS p FROM DN JOIN WT USING (cluster))
"""

# the projector onto the 32 leading directions by trace-correcting purification: squares of a matrix with eigenvalues in 0..1,
# taken or taken off so that the trace moves towards 32, until the matrix is its own square
PROJECTED = """WITH RECURSIVE P0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS z, label::BIGINT AS label FROM embeddings),
U0 AS (SELECT id, unnest(z) AS x, generate_subscripts(z, 1) AS pos FROM P0),
C0 AS (SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) AS v FROM U0 a JOIN U0 b ON a.id = b.id GROUP BY ALL),
R0 AS (SELECT i, list(v ORDER BY j) AS r FROM C0 GROUP BY i),
X0 AS (SELECT list(list_transform(r, lambda v: v / t) ORDER BY i) AS m FROM R0, (SELECT max(list_sum(list_transform(r, lambda v: abs(v)))) AS t FROM R0)),
PURE(k, m, gap) AS (SELECT 0, m, 1::DOUBLE FROM X0 UNION ALL
  SELECT k + 1, CASE WHEN abs(tq - 32) < abs(2 * tm - tq - 32) THEN q
    ELSE list_transform(m, lambda r, i: list_transform(r, lambda v, j: 2 * v - q[i][j])) END, abs(tm - tq)
  FROM (SELECT *, list_sum(list_transform(m, lambda r, i: r[i])) AS tm, list_sum(list_transform(q, lambda r, i: r[i])) AS tq
    FROM (SELECT k, m, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS q FROM PURE WHERE k < 200 AND gap > 1e-11))),
P AS (SELECT id, list_transform(m, lambda r: list_dot_product(r, z)) AS z, label FROM P0, (SELECT m FROM PURE ORDER BY k DESC LIMIT 1)),
""" + POINTS[POINTS.index("\n") + 1:]

SILHOUETTE = """, BOTH_ AS (SELECT a.id AS i, a.label AS li, b.label AS lj, a.id = b.id AS self, list_distance(a.z, b.z) AS d FROM P a CROSS JOIN P b),
A AS (SELECT i, li, lj, sum(d) AS s, count(*) AS n FROM BOTH_ GROUP BY ALL),
B AS (SELECT i, max(CASE WHEN li = lj AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN s / n END) AS b FROM A GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS sil FROM B"""

CALINSKI = """, GR AS (SELECT pos, avg(x) AS g FROM U GROUP BY pos)
SELECT round((SELECT sum(n * (m - g) ^ 2) FROM CM JOIN GR USING (pos)) * ((SELECT count(*) FROM P) - (SELECT count(*) FROM CN))
/ ((SELECT count(*) FROM CN) - 1) / (SELECT sum(d2) FROM D2 WHERE cluster = label), 6) AS chs"""

DAVIES = """, SP AS (SELECT cluster, avg(sqrt(d2)) AS s FROM D2 WHERE cluster = label GROUP BY cluster),
RR AS (SELECT a.cluster, max((sa.s + sb.s) / list_distance(a.mu, b.mu)) AS r FROM CN a JOIN CN b ON a.cluster <> b.cluster
JOIN SP sa ON sa.cluster = a.cluster JOIN SP sb ON sb.cluster = b.cluster GROUP BY a.cluster)
SELECT round(avg(r), 6) AS dbs FROM RR"""

COVARIANCE = """, DF AS (SELECT U.id, CM.label AS cluster, U.pos, x - m AS e FROM U JOIN CM ON CM.pos = U.pos)
SELECT a.cluster, (a.pos - 1) * 64 + b.pos - 1 AS pos, round(sum(q * a.e * b.e) / sum(q), 6) + 0.0 AS v
FROM DF a JOIN DF b ON a.id = b.id AND a.cluster = b.cluster JOIN QS ON QS.id = a.id AND QS.cluster = a.cluster GROUP BY a.cluster, a.pos, b.pos"""


ZINB = X.rstrip() + """,
GM AS (SELECT gene, sum(value) / (SELECT count(*) FROM T) AS mean FROM X GROUP BY gene),
G AS (SELECT coalesce(X.value, 0) AS x, mean * (n_counts / med) AS m, 2.0::DOUBLE AS d FROM T CROSS JOIN GM CROSS JOIN M
LEFT JOIN X ON X.cell = T.cell AND X.gene = GM.gene)
SELECT count(*) AS n, round(avg(CASE WHEN x <= 1e-8 THEN -ln(0.1 + 0.9 * (d / (d + m + 1e-10)) ^ d + 1e-10)
ELSE lgamma(d + 1e-10) + lgamma(x + 1) - lgamma(x + d + 1e-10) + (d + x) * ln(1 + m / (d + 1e-10))
+ x * (ln(d + 1e-10) - ln(m + 1e-10)) - ln(0.9 + 1e-10) END), 6) AS mean_nll FROM G"""

ACTIVATIONS = """WITH U AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, pos, round(least(greatest(exp(x), 1e-5), 1e6), 6) AS mean_act,
round(least(greatest(ln(1 + exp(x)), 1e-4), 1e4), 6) AS disp_act FROM U"""

_DRAWS = """, IX AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM P),
CNT AS (SELECT count(*) AS n FROM P),
H AS (SELECT range AS draw, ((range + 1) * 48271 % 2147483647) * 69621 % 2147483647 AS h2 FROM range((SELECT 64 * n + 4096 FROM CNT))),
H3 AS (SELECT draw, h2, h2 * 16807 % 2147483647 AS h3 FROM H),
H4 AS (SELECT draw, h2, h3, (h3 * 48271 + 12345) % 2147483647 AS h4 FROM H3),
DR AS (SELECT draw, (h2 * 2147483647 + h3) % n AS pa, (h4 * 2147483647 + h4 * 69621 % 2147483647) % n AS pb FROM H4, CNT),
PP AS (SELECT draw, a.id AS a, b.id AS b, a.z AS za, b.z AS zb, a.label AS la, b.label AS lb
FROM DR JOIN IX a ON a.pos = pa JOIN IX b ON b.pos = pb WHERE pa <> pb)
"""

_KEEP = """, OK AS (SELECT draw, a, b, kind FROM J WHERE kind IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY draw) = 1),
KEPT AS (SELECT a, b, kind, row_number() OVER (ORDER BY draw) AS rn FROM OK QUALIFY rn <= (SELECT n FROM CNT))
"""

LABEL_RULE = ", J AS (SELECT draw, a, b, CASE WHEN la = lb THEN 'ML' ELSE 'CL' END AS kind FROM PP)"

DISTANCE_RULE = """, CU AS (SELECT quantile_cont(d, [0.1, 0.9]) AS c FROM D),
J AS (SELECT draw, a, b, CASE WHEN list_distance(za, zb) < c[1] THEN 'ML' WHEN list_distance(za, zb) > c[2] THEN 'CL' END AS kind FROM PP, CU)"""

CLUSTER_RULE = """, CU AS (SELECT quantile_cont(d, 0.8) AS c FROM D),
J AS (SELECT draw, a, b, CASE WHEN la = lb THEN 'ML' WHEN list_distance(za, zb) > c THEN 'CL' END AS kind FROM PP, CU)"""

MARKER_RULE = """, CU AS (SELECT
(SELECT quantile_cont(z[1], [0.2, 0.4, 0.6, 0.8]) FROM P) AS c1, (SELECT quantile_cont(z[2], [0.2, 0.4, 0.6, 0.8]) FROM P) AS c2,
(SELECT quantile_cont(z[3], [0.2, 0.8]) FROM P) AS c3, (SELECT quantile_cont(z[4], [0.2, 0.8]) FROM P) AS c4),
J AS (SELECT draw, a, b, CASE
WHEN za[1] < c1[2] AND za[2] > c2[3] AND zb[1] > c1[3] AND zb[2] < c2[2] THEN 'CL'
WHEN zb[1] < c1[2] AND zb[2] > c2[3] AND za[1] > c1[3] AND za[2] < c2[2] THEN 'CL'
WHEN za[2] > c2[4] AND zb[2] > c2[4] AND ((za[3] > c3[2] AND zb[3] > c3[2]) OR (za[3] < c3[1] AND zb[3] < c3[1])) THEN 'ML'
WHEN za[1] > c1[4] AND zb[2] > c1[4] AND za[3] > c3[2] AND zb[3] > c3[2] THEN 'ML'
WHEN za[1] > c1[4] AND zb[2] > c1[4] AND za[3] < c3[1] AND zb[3] < c3[1]
AND ((za[4] > c4[2] AND zb[4] > c4[2]) OR (za[4] < c4[1] AND zb[4] < c4[1])) THEN 'ML' END AS kind FROM PP, CU)"""


def constraints(rule: str, flip: float = 0.0) -> str:
    kind = "kind"
    if flip:
        kind = f"CASE WHEN rn <= ceil({flip} * (SELECT n FROM CNT)) THEN CASE kind WHEN 'ML' THEN 'CL' ELSE 'ML' END ELSE kind END AS kind"
    return POINTS + _DRAWS + rule + _KEEP + f"SELECT a, b, {kind} FROM KEPT"


PAIRWISE = POINTS + _DRAWS + LABEL_RULE + _KEEP + """SELECT kind, round(avg(CASE WHEN kind = 'ML' THEN -ln(s) ELSE -ln(1 - s) END), 6) AS loss
FROM (SELECT k.a, k.b, k.kind, sum(x.q * y.q) AS s FROM KEPT k JOIN QS x ON x.id = k.a JOIN QS y ON y.id = k.b AND y.cluster = x.cluster
GROUP BY ALL) GROUP BY kind"""

# automatic bins: the narrower of the Freedman-Diaconis (at least half the square-root rule's) and the Sturges width
BINS = """, V AS (SELECT r AS v FROM AN WHERE r IS NOT NULL),
W AS (SELECT count(*) AS n, min(v) AS low, max(v) AS high,
      greatest(2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / count(*) ^ (1 / 3), (max(v) - min(v)) / sqrt(count(*)) / 2) AS fd,
      (max(v) - min(v)) / (log2(count(*)) + 1) AS st FROM V),
K AS (SELECT low, high, CAST(ceil((high - low) / least(fd, st)) AS BIGINT) AS bins FROM W),
C AS (SELECT least(floor((v - low) * (bins / (high - low))), bins - 1)::BIGINT AS bin, count(*) AS n FROM V, K GROUP BY 1)
SELECT bin, round(low + bin * (high - low) / bins, 6) AS low, round(low + (bin + 1) * (high - low) / bins, 6) AS high, coalesce(n, 0) AS n
FROM (SELECT unnest(range(bins)) AS bin, low, high, bins FROM K) LEFT JOIN C USING (bin)"""

DENSITY = """, V AS (SELECT r AS v FROM AN WHERE r IS NOT NULL),
W AS (SELECT count(*) AS n, min(v) AS low, max(v) AS high, stddev_samp(v) * count(*) ^ (-0.2) AS h FROM V),
X AS (SELECT low + (high - low) * k / 199 AS x, n, h FROM (SELECT unnest(range(200)) AS k), W)
SELECT round(x, 6) AS x, round(sum(exp(-0.5 * ((x - v) / h) ^ 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 5) AS density
FROM X, V GROUP BY x"""
