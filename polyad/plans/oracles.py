"""DuckDB SQL for the registered queries, written from the definitions, not from the plans."""

from __future__ import annotations

from itertools import combinations

SENT = r"""sent AS (SELECT doc_id, unnest(range(len(p))) AS sent_pos, unnest(p) AS sentence
  FROM (SELECT doc_id, string_split_regex(text, '[.!?\n]+') AS p FROM documents WHERE length(text) >= 1)),
tok AS (SELECT doc_id, sent_pos, regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+') AS t FROM sent WHERE trim(sentence) <> '')"""


def ngram_cte(n: int, name: str = "rows") -> str:
    words = ", ".join(f"t[i + {j}] AS w{j + 1}" for j in range(n))
    return f"{name} AS (SELECT doc_id, sent_pos, {words} FROM (SELECT *, unnest(range(1, len(t) - {n} + 2)) AS i FROM tok WHERE len(t) >= {n}))"


ORDERS = """rows AS (SELECT l_returnflag AS returnflag, o_orderpriority AS priority, p_brand AS brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
MARKET = """rows AS (SELECT l_returnflag AS returnflag, o_orderpriority AS priority, p_brand AS brand, c_mktsegment AS mktsegment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""
EVENTS = "rows AS (SELECT event_type, user_id::VARCHAR AS \"user\", hour(ts)::VARCHAR AS hour FROM events)"


def vocab_cte(roles: list[str], k: int) -> str:
    each = " UNION ALL ".join(f"SELECT '{r}' AS role, \"{r}\" AS token, count(*) AS cnt FROM rows GROUP BY 2" for r in roles)
    return f"marg AS ({each}), voc AS (SELECT * FROM (SELECT role, row_number() OVER (PARTITION BY role ORDER BY cnt DESC, token) - 1 AS idx, token, cnt FROM marg) WHERE idx < {k})"


def lattice_cte(roles: list[str]) -> str:
    """Tables s<indices> with the count of each subset among known tokens."""
    out = []
    n = len(roles)
    for size in range(1, n + 1):
        for s in combinations(range(n), size):
            joins = " ".join(f"JOIN voc v{j} ON v{j}.role = '{roles[j]}' AND v{j}.token = \"{roles[j]}\"" for j in s)
            columns = ", ".join(f"v{j}.idx AS i{j}" for j in s)
            out.append(f"s{''.join(map(str, s))} AS (SELECT {columns}, count(*) AS c FROM rows {joins} GROUP BY {', '.join(str(p + 1) for p in range(size))})")
    return ", ".join(out)


def populate_sql(ctes: str, roles: list[str], k: int, top_ks: tuple[int, ...] = (), tokens: bool = True) -> str:
    n = len(roles)
    every = [s for size in range(1, n + 1) for s in combinations(range(n), size)]
    name = lambda s: "s" + "".join(map(str, s))
    full = name(tuple(range(n)))
    joins = " ".join(f"JOIN {name(s)} ON {' AND '.join(f'{name(s)}.i{j} = {full}.i{j}' for j in s)}" for s in every[:-1])
    sii = " ".join(f"{'+' if len(s) % 2 == 0 else '-'} ln({name(s)}.c / t.n)" for s in every)
    sc = f"ln({full}.c / t.n) " + " ".join(f"- ln(s{j}.c / t.n)" for j in range(n))
    keys = ", ".join(f"{full}.i{j}" for j in range(n))
    tops = ", ".join(f"({t})" for t in (top_ks or (k,)))
    biggest = f"greatest({', '.join(f'i{j}' for j in range(n))})"
    soft = lambda c: f"CASE WHEN {c} > 20 THEN {c} ELSE ln(1 + exp({c})) END"
    words = "".join(f", v{j}.token AS \"{roles[j]}\"" for j in range(n)) if tokens else ""
    word_joins = " ".join(f"JOIN voc v{j} ON v{j}.role = '{roles[j]}' AND v{j}.idx = i{j}" for j in range(n)) if tokens else ""
    return f"""WITH {ctes}, {vocab_cte(roles, k)}, {lattice_cte(roles)}, t AS (SELECT count(*)::DOUBLE AS n FROM rows),
cells AS (SELECT {keys}, {full}.c::DOUBLE AS counting, {sii} AS sii, {sc} AS sc FROM {full} CROSS JOIN t {joins}),
sized AS (SELECT * FROM cells, (VALUES {tops}) k(top_k) WHERE {biggest} < top_k),
lows AS (SELECT top_k, min(sii) AS lsii, min(sc) AS lsc FROM sized GROUP BY top_k)
SELECT s.top_k::INT AS top_k, {', '.join(f'i{j}::INT AS i{j}' for j in range(n))}{words}, counting, round(sii, 6) AS sii, round(sc, 6) AS sc,
  round({soft('sii')}, 6) AS "siiSoftPlus", round({soft('sc')}, 6) AS "scSoftPlus",
  round(sii - lsii + 1e-8, 6) AS "siiShifted", round(sc - lsc + 1e-8, 6) AS "scShifted"
FROM sized s JOIN lows USING (top_k) {word_joins}"""


def vocab_sql(ctes: str, roles: list[str], k: int) -> str:
    return f"WITH {ctes}, {vocab_cte(roles, k)} SELECT role, idx::INT AS idx, token, cnt::BIGINT AS cnt FROM voc"


def linked_sql(ctes: str, roles: list[str], k: int) -> str:
    each = " UNION ALL ".join(f"SELECT '{r}' AS role, \"{r}\" AS token, count(*) AS cnt FROM rows GROUP BY 2" for r in roles)
    return f"""WITH {ctes}, marg AS ({each}),
scored AS (SELECT token, CASE WHEN count(*) = {len(roles)} THEN {len(roles)} / sum(1 / (cnt + 1e-12)) ELSE 0 END AS hm, sum(cnt) AS coverage FROM marg GROUP BY token),
best AS (SELECT token, row_number() OVER (ORDER BY hm DESC, coverage DESC, token DESC) - 1 AS idx FROM scored QUALIFY idx < {k})
SELECT r.role, b.idx::INT AS idx, b.token, coalesce(m.cnt, 0)::BIGINT AS cnt FROM best b CROSS JOIN (VALUES {', '.join(f"('{r}')" for r in roles)}) r(role)
LEFT JOIN marg m ON m.role = r.role AND m.token = b.token"""


def lattice_sql(ctes: str, roles: list[str], k: int) -> str:
    n = len(roles)
    parts = []
    for size in range(2, n + 1):
        for s in combinations(range(n), size):
            mask = sum(1 << (n - 1 - j) for j in range(n) if j not in s)
            columns = ", ".join(f"i{j}::INT AS i{j}" if j in s else f"NULL::INT AS i{j}" for j in range(n))
            parts.append(f"SELECT {mask}::INT AS subset, {columns}, c::BIGINT AS cnt FROM s{''.join(map(str, s))}")
    return f"WITH {ctes}, {vocab_cte(roles, k)}, {lattice_cte(roles)} {' UNION ALL '.join(parts)}"


ROLES = ["returnflag", "priority", "brand"]


def model_cte(k: int = 1000) -> str:
    """The closed-form model: voc, nz (counts), f0 f1 f2 (i, r, v), core (p, q, s, v), xhat at nonzeros."""
    factors = ", ".join(f"f{m} AS (SELECT idx AS i, token, r, ((31 * idx + 17 * r + {m + 1}) % 97 + 1) / 97.0::DOUBLE AS v FROM voc, range(2) x(r) WHERE role = '{role}')" for m, role in enumerate(ROLES))
    return f"""{ORDERS}, {vocab_cte(ROLES, k)}, {factors},
core AS (SELECT p, q, s, ((7 * p + 5 * q + 3 * s) % 11 + 1) / 11.0::DOUBLE AS v FROM range(2) a(p), range(2) b(q), range(2) c(s)),
nz AS (SELECT a.idx AS i0, b.idx AS i1, c.idx AS i2, count(*)::DOUBLE AS x FROM rows
  JOIN voc a ON a.role = 'returnflag' AND a.token = returnflag JOIN voc b ON b.role = 'priority' AND b.token = priority
  JOIN voc c ON c.role = 'brand' AND c.token = brand GROUP BY 1, 2, 3),
term AS (SELECT i0, i1, i2, x, p, q, s, core.v AS g, f0.v AS a, f1.v AS b, f2.v AS c FROM nz CROSS JOIN core
  JOIN f0 ON f0.i = i0 AND f0.r = p JOIN f1 ON f1.i = i1 AND f1.r = q JOIN f2 ON f2.i = i2 AND f2.r = s),
xhat AS (SELECT i0, i1, i2, any_value(x) AS x, sum(g * a * b * c) AS r FROM term GROUP BY 1, 2, 3),
sums AS (SELECT 0 AS m, r, sum(v) AS v FROM f0 GROUP BY r UNION ALL SELECT 1, r, sum(v) FROM f1 GROUP BY r UNION ALL SELECT 2, r, sum(v) FROM f2 GROUP BY r),
gram AS ({' UNION ALL '.join(f'SELECT {m} AS m, a.r AS r1, b.r AS r2, sum(a.v * b.v) AS v FROM f{m} a JOIN f{m} b ON a.i = b.i GROUP BY 2, 3' for m in range(3))})"""


TUPLE = ("R", "1-URGENT", "Brand#12")


def with_model(select: str, extra: str = "", k: int = 1000) -> str:
    return f"WITH {model_cte(k)}{extra} {select}"


KL_FACTOR = with_model("""SELECT f0.i::INT AS i, f0.r::INT AS r, round(f0.v * num.v / den.v, 6) AS value FROM f0
JOIN (SELECT t.i0 AS i, t.p AS r, sum(t.x / h.r * t.g * t.b * t.c) AS v FROM term t JOIN xhat h USING (i0, i1, i2) GROUP BY 1, 2) num USING (i, r)
JOIN (SELECT p AS r, sum(core.v * a.v * b.v) AS v FROM core JOIN sums a ON a.m = 1 AND a.r = q JOIN sums b ON b.m = 2 AND b.r = s GROUP BY p) den USING (r)""")

FR_FACTOR = with_model("""SELECT f0.i::INT AS i, f0.r::INT AS r, round(f0.v * num.v / den.v, 6) AS value FROM f0
JOIN (SELECT i0 AS i, p AS r, sum(x * g * b * c) AS v FROM term GROUP BY 1, 2) num USING (i, r)
JOIN (SELECT f.i, z.r2 AS r, sum(f.v * z.v) AS v FROM f0 f JOIN zz z ON z.r1 = f.r GROUP BY 1, 2) den USING (i, r)""",
    """, zz AS (SELECT c.p AS r1, d.p AS r2, sum(c.v * g1.v * g2.v * d.v) AS v FROM core c JOIN gram g1 ON g1.m = 1 AND g1.r1 = c.q
  JOIN gram g2 ON g2.m = 2 AND g2.r1 = c.s JOIN core d ON d.q = g1.r2 AND d.s = g2.r2 GROUP BY 1, 2)""")  # fmt: skip

KL_CORE = with_model("""SELECT core.p::INT AS r0, core.q::INT AS r1, core.s::INT AS r2, round(core.v * num.v / (a.v * b.v * c.v), 6) AS value FROM core
JOIN (SELECT t.p, t.q, t.s, sum(t.x / h.r * t.a * t.b * t.c) AS v FROM term t JOIN xhat h USING (i0, i1, i2) GROUP BY 1, 2, 3) num USING (p, q, s)
JOIN sums a ON a.m = 0 AND a.r = p JOIN sums b ON b.m = 1 AND b.r = q JOIN sums c ON c.m = 2 AND c.r = s""")

_NORMS = """, low AS (SELECT g0.r2 AS p, g1.r2 AS q, g2.r2 AS s, sum(core.v * g0.v * g1.v * g2.v) AS v FROM core
  JOIN gram g0 ON g0.m = 0 AND g0.r1 = p JOIN gram g1 ON g1.m = 1 AND g1.r1 = q JOIN gram g2 ON g2.m = 2 AND g2.r1 = s GROUP BY 1, 2, 3)"""
FR_CORE = with_model("""SELECT core.p::INT AS r0, core.q::INT AS r1, core.s::INT AS r2, round(core.v * num.v / low.v, 6) AS value FROM core
JOIN (SELECT p, q, s, sum(x * a * b * c) AS v FROM term GROUP BY 1, 2, 3) num USING (p, q, s) JOIN low USING (p, q, s)""", _NORMS)

ERRORS = with_model("""SELECT round((kl + mass - r) / x, 6) AS kl_error, round(sqrt(greatest(xx + norm - 2 * xr, 0)) / sqrt(xx), 6) AS fr_error
FROM (SELECT sum(x) AS x, sum(x * x) AS xx, sum(x * r) AS xr, sum(r) AS r, sum(x * ln(x / r) - x + r) AS kl FROM xhat),
(SELECT sum(core.v * a.v * b.v * c.v) AS mass FROM core JOIN sums a ON a.m = 0 AND a.r = p JOIN sums b ON b.m = 1 AND b.r = q JOIN sums c ON c.m = 2 AND c.r = s),
(SELECT sum(core.v * low.v) AS norm FROM core JOIN low USING (p, q, s))""", _NORMS)

SCORES = with_model("""SELECT a.token AS returnflag, b.token AS priority, c.token AS brand, round(r, 6) AS score FROM xhat
JOIN voc a ON a.role = 'returnflag' AND a.idx = i0 JOIN voc b ON b.role = 'priority' AND b.idx = i1 JOIN voc c ON c.role = 'brand' AND c.idx = i2""")

#: Predicted vectors of each role for every tuple that occurs.
PREDICTED = """, predicted AS (
  SELECT i0, i1, i2, 0 AS m, p AS r, sum(g * b * c) AS v FROM term GROUP BY i0, i1, i2, p UNION ALL
  SELECT i0, i1, i2, 1, q, sum(g * a * c) FROM term GROUP BY i0, i1, i2, q UNION ALL
  SELECT i0, i1, i2, 2, s, sum(g * a * b) FROM term GROUP BY i0, i1, i2, s),
fac AS (SELECT 0 AS m, i, token, r, v FROM f0 UNION ALL SELECT 1, i, token, r, v FROM f1 UNION ALL SELECT 2, i, token, r, v FROM f2)"""


def vectors_sql(mode: int, included: bool) -> str:
    own = f" * f{mode}.v" if included else ""
    return with_model(f"""SELECT a.token AS returnflag, b.token AS priority, c.token AS brand, round(max(CASE WHEN x.r = 0 THEN x.v{own} END), 6) AS x0, round(max(CASE WHEN x.r = 1 THEN x.v{own} END), 6) AS x1
FROM predicted x JOIN voc a ON a.role = 'returnflag' AND a.idx = i0 JOIN voc b ON b.role = 'priority' AND b.idx = i1 JOIN voc c ON c.role = 'brand' AND c.idx = i2
JOIN f{mode} ON f{mode}.i = i{mode} AND f{mode}.r = x.r WHERE x.m = {mode} GROUP BY 1, 2, 3""", PREDICTED)  # fmt: skip


RANKED = """, cosine AS (SELECT w.i0, w.i1, w.i2, w.m, f.i, greatest(-1, least(1, sum(w.v * f.v) / (sqrt(sum(w.v * w.v)) * sqrt(sum(f.v * f.v))))) AS c
  FROM predicted w JOIN fac f ON f.m = w.m AND f.r = w.r GROUP BY 1, 2, 3, 4, 5),
own AS (SELECT c.*, t.c AS target FROM cosine c JOIN cosine t USING (i0, i1, i2, m) WHERE t.i = CASE m WHEN 0 THEN i0 WHEN 1 THEN i1 ELSE i2 END),
ranked AS (SELECT i0, i1, i2, m, count(*) FILTER (c >= target - 1e-12) AS rank, exp(any_value(target) / 0.1) / sum(exp(c / 0.1)) AS prob FROM own GROUP BY 1, 2, 3, 4)"""

METRICS = with_model("""SELECT round(sum(1 / rank) / 3 / (count(*) / 3), 6) AS average_rank_score, round(sum(prob) / 3 / (count(*) / 3), 6) AS average_prob_score,
round(sum(1 / rank) / 3 / (count(*) / 3), 6) AS absolute_rank_score, round(sum(prob) / 3 / (count(*) / 3), 6) AS absolute_prob_score,
0::BIGINT AS "OOV", 0.0::DOUBLE AS "OOV_rate", round(sum(prob) / 3 / (count(*) / 3), 6) AS tilde_excluded_prob_score, 0.0::DOUBLE AS tilde_rate FROM ranked""", PREDICTED + RANKED)

EXPECTED = with_model("""SELECT f.token, round(sum(w.v * f.v), 6) AS score, round(any_value(n.c), 6) AS activation_cosine FROM
(SELECT m, r, v, i0, i1, i2 FROM predicted JOIN voc a ON a.role = 'returnflag' AND a.idx = i0 JOIN voc b ON b.role = 'priority' AND b.idx = i1 JOIN voc c ON c.role = 'brand' AND c.idx = i2
 WHERE m = 2 AND a.token = 'R' AND b.token = '1-URGENT' AND c.idx = 0) w JOIN f2 f ON f.r = w.r
JOIN (SELECT x.i, sum(x.v * y.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v))) AS c FROM f2 x JOIN f2 y ON y.i = 0 AND x.r = y.r GROUP BY x.i) n ON n.i = f.i
GROUP BY f.token ORDER BY sum(w.v * f.v) DESC LIMIT 5""", PREDICTED)

SIMILAR = with_model("""SELECT x.token, round(sum(x.v * y.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v))), 6) AS cosine
FROM f2 x JOIN f2 y ON y.i = 0 AND x.r = y.r GROUP BY x.token, x.i ORDER BY cosine DESC, x.i LIMIT 5""")

COMBINATIONS = with_model("""SELECT 'R' AS returnflag, b.token AS priority, c.token AS brand, round(sum(core.v * a.v * b.v * c.v), 6) AS score FROM core
JOIN f0 a ON a.token = 'R' AND a.r = p JOIN f1 b ON b.r = q JOIN f2 c ON c.r = s GROUP BY 2, 3 ORDER BY sum(core.v * a.v * b.v * c.v) DESC, priority, brand LIMIT 10""")

TOP_WORDS = with_model("SELECT token, round(v, 6) AS score FROM f2 WHERE r = 1 ORDER BY v DESC, i LIMIT 10")

#: A model of the 10 most frequent brands, extended by the others.
EXTENDED = with_model("""SELECT 'brand' AS role, token, cnt::BIGINT AS cnt, round(v0 * f, 6) AS x0, round(v1 * f, 6) AS x1 FROM
(SELECT *, (SELECT median(n) FROM (SELECT sqrt(sum(v * v)) AS n FROM f2 GROUP BY i)) / (sqrt(v0 * v0 + v1 * v1) + 1e-12) AS f FROM mean)""",
    """, new AS (SELECT a.idx AS i0, b.idx AS i1, brand AS token, count(*) AS n FROM rows JOIN voc a ON a.role = 'returnflag' AND a.token = returnflag
  JOIN voc b ON b.role = 'priority' AND b.token = priority WHERE brand NOT IN (SELECT token FROM voc WHERE role = 'brand') GROUP BY 1, 2, 3),
part_sum AS (SELECT new.token AS token, s, sum(n * core.v * f0.v * f1.v) AS v FROM new CROSS JOIN core JOIN f0 ON f0.i = i0 AND f0.r = p JOIN f1 ON f1.i = i1 AND f1.r = q GROUP BY 1, 2),
mean AS (SELECT token, c.cnt, sum(v) FILTER (s = 0) / c.cnt AS v0, sum(v) FILTER (s = 1) / c.cnt AS v1 FROM part_sum JOIN (SELECT token, sum(n) AS cnt FROM new GROUP BY token) c USING (token) GROUP BY 1, 2)""", 10)  # fmt: skip

SLOTS = f"""WITH {SENT}, word AS (SELECT doc_id, sent_pos, unnest(range(len(t))) AS i, unnest(t) AS lemma FROM tok),
lab AS (SELECT *, (['nsubj', 'dobj', 'dative', 'obl', 'amod', 'det'])[(length(lemma) * 3 + i) % 6 + 1] AS dep FROM word),
root AS (SELECT doc_id, sent_pos, lemma FROM lab WHERE i = 0 AND length(lemma) % 2 = 0),
child AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_pos, dep ORDER BY i) AS k FROM lab WHERE i > 0 AND (dep <> 'amod' OR i = 1)),
adj AS (SELECT doc_id, sent_pos, i - 1 AS h, lemma FROM lab WHERE dep = 'amod' AND i > 0),
s AS (SELECT * FROM child WHERE dep = 'nsubj' AND k = 1), o AS (SELECT * FROM child WHERE dep = 'dobj' AND k = 1),
second AS (SELECT doc_id, sent_pos, arg_min(lemma, i) AS lemma FROM child WHERE (dep = 'dobj' AND k = 2) OR (dep = 'dative' AND k = 1) GROUP BY 1, 2),
b AS (SELECT * FROM child WHERE dep = 'obl' AND k = 1)
SELECT doc_id, sent_pos::INT AS sent_pos, root.lemma AS root, coalesce(s.lemma, '~') AS nsubj, coalesce(o.lemma, '~') AS obj, coalesce(second.lemma, '~') AS obj2,
  coalesce(b.lemma, '~') AS obl, coalesce(sa.lemma, '~') AS adj_nsubj, coalesce(oa.lemma, '~') AS adj_obj
FROM root LEFT JOIN s USING (doc_id, sent_pos) LEFT JOIN o USING (doc_id, sent_pos) LEFT JOIN second USING (doc_id, sent_pos) LEFT JOIN b USING (doc_id, sent_pos)
LEFT JOIN adj sa ON sa.doc_id = root.doc_id AND sa.sent_pos = root.sent_pos AND sa.h = s.i LEFT JOIN adj oa ON oa.doc_id = root.doc_id AND oa.sent_pos = root.sent_pos AND oa.h = o.i"""

_FRAMES = """el AS (SELECT p_brand AS frame, p_type AS element, (['Core', 'Peripheral', 'Core-Unexpressed', 'Extra-Thematic', 'Other'])[min(p_size) % 5 + 1] AS kind, count(*) FILTER (p_size > 10) AS freq FROM part GROUP BY 1, 2),
pri AS (SELECT *, kind LIKE 'Core%' AS core, CASE kind WHEN 'Core' THEN 0 WHEN 'Core-Unexpressed' THEN 1 WHEN 'Extra-Thematic' THEN 2 WHEN 'Peripheral' THEN 3 ELSE 4 END AS priority FROM el),
blue AS (SELECT frame, element, core, row_number() OVER (PARTITION BY frame ORDER BY core DESC, priority, freq DESC, element) - 1 AS pos FROM pri QUALIFY core OR pos < 6)"""
BLUEPRINT = f"WITH {_FRAMES} SELECT frame, element, core, pos::INT AS pos FROM blue"
CANONICAL = f"""WITH {_FRAMES}, cut AS (SELECT * FROM blue WHERE pos < 5), spot AS (SELECT element, pos, count(*) AS n FROM cut GROUP BY 1, 2),
usual AS (SELECT element, (SELECT pos FROM spot b WHERE b.element = a.element ORDER BY n DESC, pos LIMIT 1) AS usual, sum(n) AS freq FROM spot a GROUP BY element)
SELECT frame, (row_number() OVER (PARTITION BY frame ORDER BY usual, freq DESC, element) - 1)::INT AS slot, element FROM cut JOIN usual USING (element)"""

NEAREST = """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)
SELECT vec_id, id AS neighbour, round(list_dot_product(e, f) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(f, f)), 6) AS cosine
FROM q JOIN c ON vec_id <> id QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, id) <= 5"""

LINKED_EXTENSIONS = """WITH a AS (SELECT p_brand AS token, count(*) AS c, sum(p_size) AS s FROM part GROUP BY 1),
m AS (SELECT token, CASE WHEN s % 2 = 0 THEN 3 * c ELSE c END AS cnt, CASE WHEN s % 2 = 0 THEN (s * c + s / 2 * 2 * c) / (3.0 * c) ELSE s END AS v0, CASE WHEN s % 2 = 0 THEN (c * c + c / 2 * 2 * c) / (3.0 * c) ELSE c END AS v1 FROM a)
SELECT role, token, cnt::BIGINT AS cnt, round(v0::DOUBLE, 6) AS x0, round(v1::DOUBLE, 6) AS x1 FROM m, (VALUES ('a'), ('b')) r(role)"""
