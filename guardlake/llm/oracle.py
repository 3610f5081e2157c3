"""DuckDB statements that answer registered queries of this subpackage independently."""

from __future__ import annotations

from guardlake.llm import licenses, warc


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digest(of: str) -> str:
    """``sha1:`` and base 32, five hex digits giving four letters at a time."""
    return (
        f"'sha1:' || array_to_string([substr('{warc.BASE32}', ((('0x' || substr(sha1({of}), 5 * (i // 4) + 1, 5))::INT "
        ">> (15 - 5 * (i % 4))) & 31) + 1, 1) for i in range(0, 32)], '')"
    )


def _uuid(of: str) -> str:
    parts = " || '-' || ".join(f"substr(sha1({of}), {start}, {n})" for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {parts} || '>'"


def _numbered(of: str) -> str:
    """Character references by number resolved."""
    ref = "'^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});'"
    code = (
        f"(CASE WHEN lower(x[1]) = 'x' THEN ('0x' || regexp_extract(x, {ref}, 1)[2:])::INT ELSE regexp_extract(x, {ref}, 1)::INT END)"
    )
    number = (
        f"CASE WHEN regexp_extract(x, {ref}, 1) = '' THEN '&#' || x ELSE (CASE WHEN {code} < 1 OR {code} > 1114111 OR {code} "
        f"BETWEEN 55296 AND 57343 THEN chr(65533) WHEN {code} = 65279 THEN '' ELSE chr({code}) END) || "
        f"substr(x, length(regexp_extract(x, {ref}, 1)) + 2) END"
    )
    return (
        f"CASE WHEN contains({of}, '&#') THEN string_split({of}, '&#')[1] || array_to_string("
        f"[{number} for x in string_split({of}, '&#')[2:]], '') ELSE {of} END"
    )


def _named(of: str) -> str:
    """Character references by name resolved."""
    for name, char in warc.NAMED:
        of = f"replace({of}, '&{name};', {_quoted(char)})"
    return of


def _warc() -> str:
    tags = "html"
    tags = f"regexp_replace({tags}, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
    tags = f"regexp_replace({tags}, '{warc.SILENT_ELEMENT}', ' ', 'g')"
    tags = f"regexp_replace({tags}, '[\\r\\n\\t\\f\\x0B ]+', ' ', 'g')"
    tags = f"regexp_replace({tags}, '(?i)</?(?:{warc.BREAKING})\\b[^>]*>', chr(10), 'g')"
    tags = f"regexp_replace({tags}, '<[/!?a-zA-Z][^>]*>', '', 'g')"
    named = f"regexp_replace({_named('t')}, '[\\r\\t\\f\\x0B \\x{{A0}}]+', ' ', 'g')"
    named = f"trim(regexp_replace({named}, ' ?\\n[\\n ]*', chr(10), 'g'), ' ' || chr(10))"
    inner = "CASE WHEN u[1] IN (chr(34), chr(39)) THEN u[2:-2] ELSE u END"
    address = f"trim(translate({_named('(' + _numbered('(' + inner + ')') + ')')}, chr(9) || chr(10) || chr(13), ''))"
    links = f"['outlink: ' || {address} || chr(13) || chr(10) for u in regexp_extract_all(html, {_quoted(warc.LINK)}, 1)]"
    eol = "chr(13) || chr(10)"
    return f"""
WITH source AS (
  SELECT page_id, url, html, sha1(html) AS payload_sha,
    'HTTP/1.1 200 OK' || {eol} || 'Content-Type: text/html; charset=utf-8' || {eol} || 'Content-Length: ' || strlen(html) AS http
  FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)
),
response AS (
  SELECT *, {_uuid("url || '#' || payload_sha")} AS id, {_digest("html")} AS payload_digest,
    {_digest(f"http || {eol} || {eol} || html")} AS source_digest, strlen(http) + 4 + strlen(html) AS block_size,
    regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title', 1) AS title_html
  FROM source
),
stripped AS (
  SELECT page_id, part, {tags} AS t
  FROM (SELECT page_id, 'body' AS part, html FROM response UNION ALL SELECT page_id, 'title', title_html FROM response)
),
numbered AS (
  SELECT page_id, part, {_numbered("t")} AS t
  FROM stripped
),
texts AS (SELECT page_id, part, {named} AS t FROM numbered),
whole AS (
  SELECT r.*, b.t AS body, t.t AS title, {_uuid("r.id || '#conversion'")} AS conversion_id, {_uuid("r.id || '#metadata'")} AS metadata_id
  FROM response r JOIN texts b ON b.page_id = r.page_id AND b.part = 'body' JOIN texts t ON t.page_id = r.page_id AND t.part = 'title'
),
made AS (
  SELECT page_id, 'conversion' AS record_type, conversion_id AS record_id, id, url, payload_digest, 'text/plain; charset=UTF-8' AS kind, body AS block
  FROM whole
  UNION ALL
  SELECT page_id, 'metadata', metadata_id, id, url, payload_digest, 'application/warc-fields',
    'source-record-id: ' || id || {eol} || 'source-payload-digest: ' || payload_digest || {eol}
    || 'source-payload-digest-holds: true' || {eol} || 'source-block-digest: ' || source_digest || {eol}
    || 'source-block-digest-holds: true' || {eol} || 'source-content-type: application/http; msgtype=response' || {eol}
    || 'source-content-length: ' || block_size || {eol} || 'conversion-record-id: ' || conversion_id || {eol}
    || CASE WHEN title <> '' THEN 'title: ' || title || {eol} ELSE '' END
    || 'http-header: ' || replace(http, {eol}, {eol} || 'http-header: ') || {eol}
    || array_to_string({links}, '')
  FROM whole
),
digested AS (SELECT *, {_digest("block")} AS block_digest FROM made)
SELECT page_id, record_type, record_id, id AS refers_to, url AS target_uri, block, block_digest,
  sha256('WARC/1.1' || {eol} || 'WARC-Type: ' || record_type || {eol} || 'WARC-Record-ID: ' || record_id || {eol}
    || 'WARC-Date: 2024-01-01T00:00:00Z' || {eol} || CASE WHEN url <> '' THEN 'WARC-Target-URI: ' || url || {eol} ELSE '' END
    || 'WARC-Refers-To: ' || id || {eol} || CASE WHEN url <> '' THEN 'WARC-Refers-To-Target-URI: ' || url || {eol} ELSE '' END
    || 'WARC-Refers-To-Date: 2024-01-01T00:00:00Z' || {eol} || 'WARC-Source-Payload-Digest: ' || payload_digest || {eol}
    || 'WARC-Block-Digest: ' || block_digest || {eol} || 'Content-Type: ' || kind || {eol}
    || 'Content-Length: ' || strlen(block) || {eol} || {eol} || block || {eol} || {eol}) AS record_sha256
FROM digested
"""


def _bigrams(of: str) -> str:
    plain = f"trim(regexp_replace(translate({of}, '{licenses.UPPER}', '{licenses.UPPER.lower()}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"string_split({plain}, ' ')"


def _licenses() -> str:
    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.TEMPLATES)
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
WITH known AS (
  SELECT license, {pairs} AS wanted FROM (SELECT license, {_bigrams("wording")} AS w FROM (VALUES {rows}) v(license, wording))
),
whole AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents),
cut AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls, string_split_regex(t, '\\n[ \\t]*\\n[ \\t\\n]*') AS ps FROM whole),
units AS (
  SELECT doc_id, 'line' AS level, (i - 1)::INT AS unit, ls[i] AS body FROM cut, range(1, len(ls) + 1) r(i)
  UNION ALL
  SELECT doc_id, 'paragraph', (i - 1)::INT, ps[i] FROM cut, range(1, len(ps) + 1) r(i) WHERE contains(ps[i], chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, t FROM cut WHERE len(ps) > 1
),
grams AS (SELECT doc_id, level, unit, {pairs} AS own FROM (SELECT *, {_bigrams("body")} AS w FROM units)),
near AS (
  SELECT doc_id, level, unit, license, 2 * len(list_intersect(own, wanted)) / (len(own) + len(wanted)) AS dice
  FROM grams JOIN known ON 2 * least(len(own), len(wanted)) >= 0.8 * (len(own) + len(wanted)) - 1e-9 AND len(own) > 0
)
SELECT doc_id, level, unit, license, dice FROM near WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, level, unit ORDER BY dice DESC, license) = 1
"""


_LINEDEDUP = r"""
WITH l AS (
  SELECT doc_id, i AS pos, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) r(i)
),
numbered AS (SELECT *, count(*) FILTER (WHERE line <> '') OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx FROM l),
p AS (
  SELECT doc_id, idx, line, words, sum(words) OVER (PARTITION BY doc_id ORDER BY idx) - words AS before
  FROM (SELECT *, len(regexp_extract_all(line, '[^ \t\x0B\f\r]+')) AS words FROM numbered WHERE line <> '')
),
w AS (
  SELECT doc_id, idx, max(idx) OVER win AS stop, sum(words) OVER win AS total, string_agg(line, chr(10)) OVER win AS body
  FROM p WINDOW win AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
x AS (SELECT *, coalesce(lead(stop) OVER (PARTITION BY doc_id ORDER BY idx), stop) AS next_stop FROM w),
g AS (
  SELECT x.doc_id, x.idx, k, string_agg(p.line, chr(10) ORDER BY p.idx) AS body
  FROM (SELECT doc_id, idx, unnest(range(stop, next_stop + 1)) AS k FROM x WHERE total >= 50) x
  JOIN p ON p.doc_id = x.doc_id AND p.idx BETWEEN x.idx AND k
  GROUP BY ALL
),
m AS (SELECT doc_id, idx, k FROM g QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, idx) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(idx, k + 1)) AS idx FROM m),
kept AS (
  SELECT n.doc_id, n.pos, n.raw
  FROM numbered n
  LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.idx = n.idx
  LEFT JOIN gone h ON h.doc_id = n.doc_id AND h.idx = n.idx + 1
  WHERE NOT (CASE WHEN n.line <> '' THEN g.idx IS NOT NULL ELSE g.idx IS NOT NULL AND h.idx IS NOT NULL END)
),
joined AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, length(t)::INT AS n_chars, t AS text
FROM (SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS t FROM documents d LEFT JOIN joined j USING (doc_id)) d
"""

_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_NEGATIVES = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_SOUND}
),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


def _centroids(rounds: int = 10) -> str:
    def assigned(n: int) -> str:
        square = "list_sum([(v.c[i] - t.c[i]) * (v.c[i] - t.c[i]) for i in range(1, 65)])"
        return f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(v.c) AS c, min({square}::BIGINT * 8 + t.k) AS m FROM v, c{n} t GROUP BY vec_id)"

    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS c FROM embeddings WHERE len(embedding) = 64 AND {_SOUND})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, c FROM (SELECT c, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8))",
    ]
    for n in range(rounds):
        steps += [
            assigned(n),
            f"s{n} AS (SELECT m % 8 AS k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m, unnest(c) AS x, unnest(range(64)) AS i FROM a{n}) GROUP BY ALL)",
            f"m{n} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY k)",
            f"c{n + 1} AS MATERIALIZED (SELECT t.k, coalesce(m.c, t.c) AS c FROM c{n} t LEFT JOIN m{n} m USING (k))",
        ]
    return (
        f"WITH {', '.join(steps)}, {assigned(rounds)} "
        "SELECT vec_id, k::INT AS cluster, m // 8 AS distance, sum(m // 8) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, "
        "sum(m // 8) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 "
        f"FROM (SELECT vec_id, m, m % 8 AS k FROM a{rounds}) a JOIN c{rounds} USING (k)"
    )


ORACLE = {
    "op1_warc": _warc(),
    "op3_licenses": _licenses(),
    "op8_linededup": _LINEDEDUP,
    "op12_negatives": _NEGATIVES,
    "op13_centroids": _centroids(),
}
