"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from vecspark.llm import mixing as M
from vecspark.llm import quality_rules as Q
from vecspark.llm import url_reputation as U


def quality_sql() -> str:
    space = r"[ \t\n\r\f\v]"
    classes = ["".join(rf"\p{{{c}}}" for c in cs.split()) for cs in Q.CATEGORIES]
    classes[6] += r"\t\n\r\f\v"
    classes = [f"[{c}]" if c else None for c in classes]
    count = [f"length(regexp_replace(s, '{c}', '', 'g'))" if c else "" for c in classes]
    counts = ", ".join(f"length(s) - {c} AS c{i}" for i, c in enumerate(count) if i)
    rest = " - ".join(["length(s)", *[f"c{i}" for i in range(1, Q.CLASSES)]])
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, text, coalesce(text, '') AS s FROM documents),
w AS (SELECT rid, lang, word FROM (SELECT rid, lang, unnest(string_split_regex(lower(s), '{space}+')) AS word FROM t) WHERE word <> ''),
top AS (SELECT lang, word, r FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM w GROUP BY lang, word) WHERE r <= {Q.COMMON_WORDS}),
wc AS (SELECT rid, w.lang, 'w' AS kind, coalesce(r, {Q.COMMON_WORDS + 1}) AS bin, count(*) AS n FROM w LEFT JOIN top USING (lang, word) GROUP BY ALL),
c0 AS (SELECT rid, lang, s, {counts} FROM t),
cc AS (SELECT rid, lang, 'c' AS kind, unnest(range({Q.CLASSES})) AS bin, unnest([{rest}, {", ".join(f"c{i}" for i in range(1, Q.CLASSES))}]) AS n FROM c0),
h AS (SELECT * FROM wc UNION ALL SELECT * FROM cc WHERE n > 0),
total AS (SELECT rid, kind, sum(n) AS total FROM h GROUP BY ALL),
ref0 AS (SELECT lang, kind, bin, sum(n * {Q.SCALE} // total) AS q FROM h JOIN total USING (rid, kind) GROUP BY ALL),
ref AS (SELECT lang, kind, bin, q / sum(q) OVER (PARTITION BY lang, kind) AS q FROM ref0),
pq AS (SELECT t.rid, x.kind, coalesce(h.n, 0) / x.total AS p, ref.q FROM t JOIN total x USING (rid) JOIN ref ON ref.lang = t.lang AND ref.kind = x.kind LEFT JOIN h ON h.rid = t.rid AND h.kind = x.kind AND h.bin = ref.bin),
js AS (SELECT rid, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d FROM pq GROUP BY ALL),
a AS (SELECT t.rid, t.doc_id, t.text, length(s) AS chars, coalesce(x.total, 0)::BIGINT AS n, coalesce(jc.d, 0) AS jc, coalesce(jw.d, 0) AS jw
  FROM t LEFT JOIN total x ON x.rid = t.rid AND x.kind = 'w' LEFT JOIN js jc ON jc.rid = t.rid AND jc.kind = 'c' LEFT JOIN js jw ON jw.rid = t.rid AND jw.kind = 'w')
SELECT doc_id, CASE WHEN text IS NOT NULL THEN n END AS n_words, CASE WHEN text IS NOT NULL THEN round(jc, 6) END AS js_chars, CASE WHEN text IS NOT NULL THEN round(jw, 6) END AS js_words,
  NOT (chars >= {Q.MIN_CHARS} AND jc > {Q.MAX_CHAR_DISTANCE} + {Q.CHAR_SLACK} / sqrt(greatest(1, chars)) OR n >= {Q.MIN_WORDS} AND jw > {Q.MAX_WORD_DISTANCE} + {Q.WORD_SLACK} / sqrt(greatest(1, n))) AS keep
FROM a"""


def snapshots_sql(arrivals: int) -> str:
    return f"""
SELECT a::INTEGER AS arrival, compacted, count(doc_row) AS n_rows, coalesce(sum(doc_id), 0)::BIGINT AS ids, coalesce(sum(length(text)), 0)::BIGINT AS chars
FROM (SELECT unnest(range({arrivals})) AS a) v CROSS JOIN (VALUES (true), (false)) k(compacted)
LEFT JOIN (SELECT *, 1 AS doc_row, coalesce(doc_id, 0) % {arrivals} AS part FROM documents) d ON d.part <= a GROUP BY ALL"""


LINE_DEDUP = """
WITH t AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM t WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS k
  FROM (SELECT doc_id, text, l, unnest(range(len(l) - 2)) AS pos FROM l WHERE len(l) >= 3) WHERE l[pos + 1] || l[pos + 2] || l[pos + 3] <> ''),
later AS (SELECT doc_id, text, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, text, pos) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, text, pos + unnest([0, 1, 2]) AS pos FROM later),
kept AS (SELECT doc_id, text, string_agg(line, chr(10) ORDER BY i) AS left_text FROM
  (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM t WHERE text IS NOT NULL) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id IS NOT DISTINCT FROM x.doc_id AND g.text = x.text AND g.pos = x.i) GROUP BY ALL),
n AS (SELECT doc_id, text, count(*) AS n FROM gone GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.left_text, '') END AS text, coalesce(n.n, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN kept ON kept.doc_id IS NOT DISTINCT FROM d.doc_id AND kept.text = d.text LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM d.doc_id AND n.text = d.text"""


def _mixing_steps() -> tuple[str, str]:
    """The common table expressions of raking, and the name of the last."""
    hits = ", ".join(f"len(regexp_extract_all(s, '{p}'))" for _, p in M.TOPICS)
    names = ", ".join(f"'{t}'" for t, _ in M.TOPICS)
    steps, last = [], "w0"
    for r in range(M.ROUNDS):
        for d in M.DIMENSIONS:
            name = f"w{r * len(M.DIMENSIONS) + M.DIMENSIONS.index(d) + 1}"
            steps.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, want_source, want_lang, want_topic, least(tokens, w * (want_{d} / greatest(sum(w) OVER (PARTITION BY {d}), 1e-300))) AS w FROM {last})")
            last = name
    wants = ", ".join(f"t_{d} AS (SELECT {d}, s / sum(s) OVER () * (SELECT sum(tokens) FROM cells) * {M.BUDGET} AS want_{d} FROM (SELECT {d}, pow(sum(tokens), {M.EXPONENTS[d]}) AS s FROM cells GROUP BY {d}))" for d in M.DIMENSIONS)
    return f"""
a AS (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS s FROM documents),
b AS (SELECT *, len(regexp_extract_all(s, '{M.WORD}')) AS n, [{hits}] AS hits FROM a),
c AS (SELECT *, CASE WHEN list_max(hits) > 0 AND list_max(hits) * {M.TOPIC_WORDS} >= n THEN [{names}][list_position(hits, list_max(hits))] ELSE '{M.OTHER_TOPIC}' END AS topic FROM b),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM c WHERE n > 0 GROUP BY ALL),
{wants},
w0 AS MATERIALIZED (SELECT cells.*, want_source, want_lang, want_topic, tokens * {M.BUDGET} AS w FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{", ".join(steps)}""", last


def mixing_sql() -> str:
    steps, last = _mixing_steps()
    return f"""
WITH {steps},
p AS (SELECT c.*, CASE WHEN n > 0 THEN x.w / x.tokens ELSE 1 END AS p FROM c LEFT JOIN {last} x USING (source, lang, topic))
SELECT doc_id, topic, n AS n_tokens, round(p, 6) AS probability,
  ('0x' || substr(md5('{M.SEED}:' || coalesce(doc_id::VARCHAR, s)), 1, 13))::BIGINT / {float(1 << 52)!r} < p AS sampled
FROM p"""


def marginals_sql() -> str:
    steps, last = _mixing_steps()
    each = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, sum(tokens)::BIGINT AS tokens, round(any_value(want_{d}), 3) AS target, round(sum(w), 3) AS expected FROM {last} GROUP BY {d}" for d in M.DIMENSIONS)
    return f"WITH {steps} {each}"


#: The document that a page's URL names, in Spark and in DuckDB.
PAGE_DOC = r"/([0-9]+)(?:\.[a-z]+)?/?(?:[?#].*)?$"


def reputation_sql() -> str:
    two = ", ".join(f"'{x}'" for x in U.SUFFIXES)
    low, high = U.STRENGTHS

    def prior(name: str, level: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT CASE WHEN t > 0 THEN g / t ELSE 0.5 END AS mu, CASE WHEN phi > 1e-9 THEN least({high}, greatest({low}, 1 / phi - 1)) ELSE {high} END AS m FROM
  (SELECT t, g, CASE WHEN t > 0 AND g / t * (1 - g / t) * (t - t2 / t - (k - 1)) > 1e-9 THEN (q - g * g / t - g / t * (1 - g / t) * (k - 1)) / (g / t * (1 - g / t) * (t - t2 / t - (k - 1))) END AS phi FROM
    (SELECT sum(n)::DOUBLE AS t, sum(good)::DOUBLE AS g, sum(n::DOUBLE * n) AS t2, sum(good::DOUBLE * good / n) AS q, count(*) AS k FROM {level} WHERE n > 0)))"""

    return f"""
WITH l AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS outcome FROM labels GROUP BY 1),
p AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{U.HOST}', 1)), '\\.+$', ''), '') AS host, try_cast(regexp_extract(url, '{PAGE_DOC}', 1) AS BIGINT) AS doc FROM pages),
o AS (SELECT page_id, host, outcome FROM p LEFT JOIN l ON l.doc_id = p.doc),
h0 AS (SELECT host, count(outcome) AS n, coalesce(sum(outcome), 0) AS good FROM o WHERE host IS NOT NULL GROUP BY 1),
h1 AS (SELECT *, CASE WHEN regexp_matches(host, '{U.ADDRESS}') THEN host WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) IN ({two}) THEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) ELSE regexp_extract(host, '([^.]+)$', 1) END AS suffix FROM h0),
h AS MATERIALIZED (SELECT *, CASE WHEN length(host) > length(suffix) + 1 THEN regexp_extract(left(host, length(host) - length(suffix) - 1), '([^.]+)$', 1) || '.' || suffix ELSE host END AS domain FROM h1),
d AS MATERIALIZED (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS MATERIALIZED (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
{prior("ps", "s")}, {prior("pd", "d")}, {prior("ph", "h")},
sm AS (SELECT suffix, (good + m * mu) / (n + m) AS above FROM s, ps),
dm AS (SELECT domain, (good + m * above) / (n + m) AS above FROM d JOIN sm USING (suffix), pd),
ab AS (SELECT h.*, good + m * above AS a, n - good + m * (1 - above) AS b FROM h JOIN dm USING (domain), ph),
r AS (SELECT *, a / (a + b) AS mean, greatest(0, a / (a + b) - {U.Z} * sqrt(a * b / (a + b + 1)) / (a + b)) AS lower FROM ab)
SELECT page_id, o.host, r.domain, r.suffix, r.n::BIGINT AS n_labelled, r.good::BIGINT AS n_good, round(r.mean, 6) AS mean, round(r.lower, 6) AS lower, o.host IS NULL OR r.lower >= {U.THRESHOLD} AS keep
FROM o LEFT JOIN r ON r.host = o.host"""
