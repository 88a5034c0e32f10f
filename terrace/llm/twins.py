"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from terrace.llm import credentials, quality

_WS = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> '')"
_LOWERED = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """(doc_id, kind, rank, s, e) of one kind: gaps and matches alternate, so places are running sums."""
    p = _quoted(pattern)
    more = " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')" if kind == "opaque" else ""
    return f"""SELECT doc_id, '{kind}' AS kind, {credentials.KINDS.index(kind)} AS rank, sum(length(g) + length(m)) OVER w - length(m) AS s,
       sum(length(g) + length(m)) OVER w AS e, v
FROM (SELECT doc_id, unnest(string_split_regex(t, {p})[:-2]) AS g, unnest(regexp_extract_all(t, {p}, 0)) AS m,
             unnest(regexp_extract_all(t, {p}, {group})) AS v, unnest(generate_series(1, len(regexp_extract_all(t, {p}, 0)))) AS i
      FROM docs WHERE regexp_matches(t, {p}))
WINDOW w AS (PARTITION BY doc_id ORDER BY i) QUALIFY length(v) >= {least}{more}"""


def _secrets() -> str:
    found = "\nUNION ALL\n".join(f"(SELECT doc_id, kind, rank, s::BIGINT AS s, e::BIGINT AS e FROM ({_kind_sql(k, *v)}))" for k, v in (credentials.STRONG | credentials.WEAK).items())
    role = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in credentials.ROLE.items()) + " END"
    need = " OR ".join(f"(a.role = '{r}' AND " + " AND ".join(f"max(CASE WHEN b.role = '{n}' THEN 1 ELSE 0 END) = 1" for n in ns) + ")" for r, ns in credentials.NEEDS.items())
    strong = len(credentials.STRONG)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in credentials.STRONG)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
parts AS (SELECT DISTINCT *, {role} AS role FROM found),
linked AS (SELECT a.doc_id, a.kind, a.rank, a.s, a.e FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND a.role <> b.role
             AND greatest(b.s - a.e, a.s - b.e) <= {credentials.SCOPE}
           WHERE a.rank >= {strong} GROUP BY a.doc_id, a.kind, a.rank, a.s, a.e, a.role HAVING {need}),
clear AS (SELECT * FROM linked l WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = l.doc_id AND p.rank < {strong} AND p.s < l.e AND l.s < p.e)),
base AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS b FROM parts WHERE rank < {strong} GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS x
          FROM (SELECT doc_id, kind, rank, s, e FROM parts WHERE rank < {strong} UNION ALL SELECT * FROM clear) GROUP BY doc_id)
SELECT docs.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in credentials.STRONG)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""


def _components(width: int, percent: int) -> str:
    return f"""WITH RECURSIVE words AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(generate_series(1, len(w) - {width - 1}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)"""


def _quality() -> str:
    w = quality.WINDOW
    level = "CASE WHEN g.rows >= {m} THEN g.{q} WHEN l.rows >= {m} THEN l.{q} ELSE o.{q} END"
    limits = []
    width = lambda q: f"(1::BIGINT << greatest(length(bin(({q})::BIGINT)) - 7, 0))"
    for m, both in quality.METRICS.items():
        bottom, q25, q50, q75, top = (f"({level.format(m=quality.MIN_GROUP, q=f'{m}_q{p}')})" for p in quality.PERCENTS)
        low = f"{bottom} - {quality.TAIL_REACH} * ({q50} - {q25}) - {width(bottom)}" if both else "0"
        limits += [f"{low} AS {m}_low", f"{top} + {quality.TAIL_REACH} * ({q75} - {q50}) + {width(top)} AS {m}_high"]

    def level_sql(keys: str) -> str:
        comma = f"{keys}, " if keys else ""
        by = f"PARTITION BY {comma}metric"
        picks = ", ".join(
            f"min(CASE WHEN metric = '{m}' AND 100 * seen >= {p} * rows THEN bucket END) AS {m}_q{p}" for m in quality.METRICS for p in quality.PERCENTS
        )
        return f"""SELECT {comma}max(rows) AS rows, {picks} FROM (
  SELECT {comma}metric, bucket, sum(n) OVER ({by} ORDER BY bucket) AS seen, sum(n) OVER ({by}) AS rows
  FROM (SELECT {comma}metric, bucket, sum(n) AS n FROM sketch GROUP BY {comma}metric, bucket)) GROUP BY {keys or "()"}"""

    inside = " AND ".join(f"m.{m} BETWEEN c.{m}_low AND c.{m}_high" for m in quality.METRICS)
    shown = ", ".join(f"m.{c}" for c in quality.COUNTS)
    return f"""WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {w - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {w - 1})) AS i FROM words WHERE len(w) >= {w})),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + {w - 1})) AS p FROM again) GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
     - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::BIGINT AS n_lines FROM words LEFT JOIN covered USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_len FROM counts),
metrics AS (UNPIVOT (SELECT lang, source, {", ".join(quality.METRICS)} FROM m WHERE NOT base_failed) ON {", ".join(quality.METRICS)} INTO NAME metric VALUE v),
sketch AS (SELECT lang, source, metric, (v::BIGINT >> greatest(length(bin(v::BIGINT)) - 7, 0)) << greatest(length(bin(v::BIGINT)) - 7, 0) AS bucket, count(*) AS n FROM metrics GROUP BY ALL),
grouped AS ({level_sql("lang, source")}), langs AS ({level_sql("lang")}), overall AS ({level_sql("")}),
c AS (SELECT g.lang, g.source, {", ".join(limits)} FROM grouped g LEFT JOIN langs l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN overall o)
SELECT m.doc_id, {shown}, m.base_failed, NOT m.base_failed AND coalesce({inside}, false) AS kept
FROM m LEFT JOIN c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source"""


_TOP_K = """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""

_WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS owner FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> owner THEN owner END AS refers_to FROM o"""

_LINES = """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(hot.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k GROUP BY r"""


def _crc_table() -> list[int]:
    """The 256 remainders of the reflected CRC-32 polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def _resampling() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    crc = f"list_reduce(list_transform(generate_series(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT), lambda c, b: xor(c >> 8, {_crc_table()}[xor(c & 255, b) + 1]), 4294967295::BIGINT)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS f FROM d), bw AS (SELECT unnest(w) AS f FROM b),
known AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM dw UNION SELECT f FROM bw)),
bucket AS (SELECT f, xor({crc}, 4294967295) % 10000 AS k FROM known),
s AS (SELECT k, count(*) AS n FROM dw JOIN bucket USING (f) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN bucket USING (f) GROUP BY k),
total AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS (SELECT k, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (total.s + 10000)::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT DISTINCT k FROM bucket) LEFT JOIN s USING (k) LEFT JOIN t USING (k) CROSS JOIN total),
weights AS (SELECT r, sum(g) AS g, count(*) AS n FROM dw JOIN bucket USING (f) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(floor(weights.g::DOUBLE / weights.n), 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT doc_id, n_features, weight, weight + noise AS score, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST) AS p FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND p <= (SELECT count(*) FROM placed WHERE able) * 10 // 100 THEN p END AS rank FROM placed"""


TWINS: dict[str, str] = {
    "op3_bit_sliced_top_k": _TOP_K,
    "op4_credential_links": _secrets(),
    "op6_token_group_join": _components(4, 85),
    "op7_warc_transactions": _WARC,
    "op9_adaptive_quality": _quality(),
    "op11_reversible_lines": _LINES,
    "op13_radix_resampling": _resampling(),
}
