"""Statements for detectors, redaction, hooks and files."""

from __future__ import annotations

from guardlake.fixed import files as file_values
from guardlake.fixed.pii import PII_PATTERNS
from guardlake.fixed.traffic import UNVERIFIED_REASON
from guardlake.plans import pii_queries, samples
from oracle.parts import (
    CHECKS, DEFAULT, PROMPTS, SEEDED, good_spans, kept_spans, lit, luhn, pick, public_ipv4,
    public_ipv6, re2, redacted, trim, verhoeff,
)

ORACLE = {}

for _i, (_name, _pattern, _check) in enumerate(DEFAULT):
    ORACLE[f"detect_{_name.lower()}"] = (
        f"with {SEEDED}, {good_spans('seeded', 'doc_id', [DEFAULT[_i]])} "
        'select key as doc_id, rule, s as "start", e as "end", v as value from good'
    )

_custom = [(n, re2(p, f), None) for n, p, f in pii_queries.CUSTOM_RULES] + DEFAULT
_by_source = (
    "select d.source, k.rule, count(*) as n from kept k join {src} d on d.doc_id = k.key group by all"
)
ORACLE["custom_rule_counts"] = (
    f"with recursive {SEEDED}, {kept_spans('seeded', 'doc_id', _custom)} " + _by_source.format(src="seeded")
)
_card = re2(next(p for n, p, _ in PII_PATTERNS if n == "CREDIT_CARD"))
ORACLE["luhn_cards"] = (
    f"with {SEEDED}, c as (select doc_id, unnest(regexp_extract_all(text, {lit(_card)})) as value from seeded) "
    f"select doc_id, value, {luhn('value')} as valid from c"
)
ORACLE["verhoeff_numbers"] = (
    "with n as (select o_orderkey, lpad((o_orderkey * 7919 + 100000000007)::varchar, 12, '0') as number from orders) "
    f"select o_orderkey, number, {verhoeff('number')} as valid from n"
)
ORACLE["public_ipv4"] = (
    "with n as (select event_id, (case when user_id % 3 = 0 then 127 else user_id % 256 end) || '.' || "
    "(event_id % 256) || '.0.' || (user_id % 200) as ip from events) "
    f"select event_id, ip, {public_ipv4('ip')} as is_public from n"
)
ORACLE["public_ipv6"] = (
    f"with n as (select event_id, {pick(samples.IPV6, 'event_id')} || "
    "(case when user_id % 2 = 0 then printf('%X', user_id) else '' end) as ip from events) "
    f"select event_id, ip, {public_ipv6('ip')} as is_public from n"
)
ORACLE["all_spans"] = (
    f"with {SEEDED}, {good_spans('seeded', 'doc_id')} "
    'select key as doc_id, rule, s as "start", e as "end", rnk as rank from good'
)
ORACLE["settled_spans"] = (
    f"with recursive {SEEDED}, {kept_spans('seeded', 'doc_id')} "
    'select k.key as doc_id, k.rule, k.s as "start", k.e as "end", substr(d.text, k.s + 1, k.e - k.s) as value '
    "from kept k join seeded d on d.doc_id = k.key"
)
ORACLE["redacted_documents"] = (
    f"with recursive {redacted('documents', 'doc_id')} select key as doc_id, red as redacted, matched from red"
)
ORACLE["redacted_outbound"] = (
    f"with recursive {SEEDED}, {redacted('seeded', 'doc_id', 'outbound')} "
    "select key as doc_id, red as redacted, matched from red"
)
ORACLE["pii_counts_by_source"] = (
    f"with recursive {kept_spans('documents', 'doc_id')} " + _by_source.format(src="documents")
)
ORACLE["seeded_counts_by_source"] = (
    f"with recursive {SEEDED}, {kept_spans('seeded', 'doc_id')} " + _by_source.format(src="seeded")
)
ORACLE["pages_pii"] = (
    f"with recursive p as (select page_id, html as text from pages), {redacted('p', 'page_id')} "
    "select key as page_id, matched <> '' as pii_detected, matched from red"
)


def _times(matched: str, factors: str) -> str:
    """Sum of several rows of kept spans as count text; ``factors`` yields (key, rule, c)."""
    return (
        f"{matched} as (select key, string_agg(rule || '=' || c, ',' order by rule) as matched from "
        f"(select key, rule, sum(c)::bigint as c from ({factors}) group by all) group by key)"
    )


ORACLE["redacted_struct"] = (
    f"with recursive {SEEDED}, {redacted('seeded', 'doc_id')}, "
    + _times(
        "tot",
        "select key, rule, 2 as c from kept union all select doc_id, 'PHONE_US', 1 from seeded",
    )
    + " select r.key as doc_id, r.key as number, red as note, 'call [REDACTED_PII_PHONE_US]' as phone, red as body, "
    "t.matched from red r join tot t on t.key = r.key"
)
ORACLE["redacted_json"] = (
    "with recursive " + SEEDED + ", raw as (select doc_id, case when doc_id % 3 = 0 then '{broken ' || text else text end "
    f"as text from seeded), {redacted('raw', 'doc_id')} select key as doc_id, red as text, matched from red"
)
ORACLE["rule_file_counts"] = ORACLE["custom_rule_counts"]
ORACLE["merged_counts"] = (
    f"with recursive {SEEDED}, {kept_spans('documents', 'doc_id', prefix='a_')}, "
    f"{kept_spans('seeded', 'doc_id', prefix='b_')}, "
    + _times("tot", "select key, rule, 1 as c from a_kept union all select key, rule, 1 from b_kept")
    + " select doc_id, coalesce(matched, '') as matched from documents left join tot on key = doc_id"
)
ORACLE["allowlisted_counts"] = (
    f"with recursive {SEEDED}, "
    + kept_spans(
        "seeded", "doc_id", extra=r"and not regexp_matches(v, '@example\.(com|org)$') and not regexp_matches(v, '^9\.18\.')"
    )
    + " "
    + _by_source.format(src="seeded")
)
ORACLE["allowlist_file_counts"] = ORACLE["allowlisted_counts"]
ORACLE["allowlist_usage"] = f"""
with {SEEDED}, w as (select unnest(regexp_split_to_array(text, '\\s+')) as word from seeded)
select 'a1' as id, '@example\\.(com|org)$' as pattern, 'allow-ui' as source, true as enabled, count(*) filter (regexp_matches(word, '@example\\.(com|org)$')) as words from w
union all select 'a2', '^9\\.18\\.', 'allow-ui', false, count(*) filter (regexp_matches(word, '^9\\.18\\.')) from w
"""
_email = re2(next(p for n, p, _ in PII_PATTERNS if n == "EMAIL"))
ORACLE["allowlist_filter"] = (
    f"with {SEEDED} select doc_id, array_to_string(list_filter(regexp_extract_all(text, {lit(_email)}), "
    r"lambda v: not regexp_matches(v, '@example\.com$')), ',') as kept from seeded"
)
_no_ipv4 = [r for r in DEFAULT if r[0] != "IPV4"]
_rule_rows = ", ".join(
    f"({lit(n)}, 'default', {str(n != 'IPV4').lower()}, {str(n in CHECKS).lower()}, {i})"
    for i, (n, _, _) in enumerate(DEFAULT)
)
ORACLE["rule_usage"] = (
    f"with recursive {SEEDED}, {kept_spans('seeded', 'doc_id', _no_ipv4)}, "
    f"r(name, source, enabled, has_validator, rule_rank) as (values {_rule_rows}) "
    "select r.*, (select count(*) from kept k where k.rule = r.name) as matches from r"
)
ORACLE["url_credentials"] = f"""
with u as (select page_id, (case when contains(url, '?') then url else url || '?v=1' end) || {pick(samples.URL_TAILS, 'page_id')} as url from pages),
s as (select page_id, url, split_part(url, '?', 1) as base, substr(url, strpos(url, '?') + 1) as q from u),
p as (select page_id, url, base, i, string_split(q, '&')[i] as part from s, unnest(range(1, len(string_split(q, '&')) + 1)) as t(i)),
n as (select *, split_part(part, '=', 1) as name,
  case when contains(part, '=') then substr(part, strpos(part, '=') + 1) else '' end as val from p where part <> ''),
f as (select *, lower(name) in ('key', 'api_key', 'apikey', 'access_token', 'token') as cred,
  row_number() over (partition by page_id, name order by i) as nth from n)
select page_id, case when bool_or(cred) then any_value(base) || '?' || string_agg(
  url_encode(name) || '=' || case when cred then '%5BREDACTED%5D' else replace(url_encode(url_decode(replace(val, '+', ' '))), '%20', '+') end,
  '&' order by i) filter (where not cred or nth = 1) else any_value(url) end as url from f group by page_id
"""
ORACLE["snapshots"] = "select doc_id, least(length(text), 500) as cut, length(text) as whole from documents"


def _residual(text: str) -> str:
    patterns = {n: p for n, p, _ in DEFAULT}
    return (
        f"(regexp_matches({text}, {lit(patterns['EMAIL'])}) or regexp_matches({text}, {lit(patterns['SSN'])}) or "
        f"regexp_matches({text}, {lit(patterns['JWT'])}) or "
        f"regexp_matches({text}, '-----BEGIN (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----') or "
        f"len(list_filter(regexp_extract_all({text}, {lit(_card)}), lambda v: {luhn('v')})) > 0)"
    )


ORACLE["residual_check"] = (
    f"with recursive {SEEDED}, {redacted('seeded', 'doc_id')} "
    f"select key as doc_id, {_residual('text')} as before, {_residual('red')} as after from red"
)
ORACLE["payload_shapes"] = """
with e as (select event_id, length(event_type) as n from events),
s(path, kind, size) as (values ('props', 'object', NULL), ('props.k', 'number', NULL), ('tags', 'array', 4),
  ('tags[0]', 'string', 1), ('tags[1]', 'null', NULL), ('tags[2]', 'boolean', NULL), ('tags[3]', 'array', 0),
  ('id', 'number', NULL))
select event_id, path, kind, size from e, s union all select event_id, 'kind', 'string', n from e
"""
ORACLE["tool_payloads"] = (
    f"with recursive {SEEDED}, {redacted('seeded', 'doc_id')} "
    "select key as doc_id, k and matched <> '' as pii_detected, "
    "case when key % 4 < 2 then red else '' end as request, "
    "case when key % 4 = 2 then red else '' end as response, "
    "case when k then matched else '' end as matched from (select *, key % 4 <> 3 as k from red)"
)
_MENTIONS = f"""{PROMPTS}, sends as (select conv_id || '-' || turn as send_id, conv_id, turn, prompt || ' see @doc/' || conv_id
  || ', (@doc/' || (conv_id + turn * 7) || ') and @nowhere!' as prompt from prompts),
named as (select send_id, path, min(ord) as ord from (select send_id, conv_id as doc, 'doc/' || conv_id as path, 0 as ord from sends
  union all select send_id, conv_id + turn * 7, 'doc/' || (conv_id + turn * 7), 1 from sends) group by all),
mentions as (select n.send_id, n.path, s.text as content, row_number() over (partition by n.send_id order by ord) as nth
  from named n join seeded s on 'doc/' || s.doc_id = n.path)"""
ORACLE["mentioned_files"] = (
    f"with {SEEDED}, {_MENTIONS} select send_id, nth, path, length(content) as n_chars from mentions"
)
ORACLE["scanned_sends"] = f"""
with recursive {SEEDED}, {_MENTIONS},
pending as (select conv_id || '-' || (turn + 1) as send_id, 'mail a@b.org ' || text as text from conversations where role = 'system'),
parts as (select send_id, 0 as part, 0 as nth, 'your prompt' as label, prompt as text from sends
  union all select send_id, 1, nth, path, content from mentions
  union all select p.send_id, 2, 0, 'an earlier message still pending in this chat', p.text from pending p join sends using (send_id)),
texts as (select row_number() over (order by send_id, part, nth) as pid, * from parts where {trim('text')} <> ''),
{redacted('texts', 'pid')},
types as (select key, string_agg(distinct rule, ', ' order by rule) as types from kept group by key),
hit as (select send_id, min(struct_pack(part := part, nth := nth, label := label, types := types)) as h
  from texts join types on key = pid group by send_id)
select t.send_id, count(*) as targets, any_value(h) is not null as blocked, any_value(h).label as label, any_value(h).types as types
from texts t left join hit using (send_id) group by t.send_id
"""

# --- files ------------------------------------------------------------------------------------------

_names = [n for n, _ in samples.FILE_NAMES]
_mimes = [m for _, m in samples.FILE_NAMES]
_FILES = (
    f"files as (select doc_id as file_id, {pick(_names, 'doc_id')} as name, {pick(_mimes, 'doc_id')} as mime, "
    "strlen(text) as size, text from seeded)"
)
_EXT = (
    r"(case when regexp_matches(base, '^\.[^.]*$') then lower(substr(base, 2)) "
    "when contains(base, '.') then lower(list_extract(string_split(base, '.'), -1)) else '' end)"
)
_WITH_EXT = (
    f"ext as (select *, {_EXT} as ext, trim(split_part(lower(mime), ';', 1)) as kind_of from "
    r"(select *, list_extract(regexp_split_to_array(name, '[\\/]'), -1) as base from files))"
)


def _in(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


_TEXTUAL = (
    f"(ext in {_in(file_values.TEXT_EXTENSIONS)} or kind_of like 'text/%' or kind_of in "
    f"{_in(file_values.TEXT_MIME_TYPES)} or kind_of like '%+json' or kind_of like '%+xml')"
)


def _classified(size: str) -> str:
    return f"""classes as (select *, case
  when ext in {_in(file_values.BINARY_EXTENSIONS)} then 'binary-extension'
  when ext in {_in(file_values.OFFICE_EXTENSIONS)} then (case when {size} > 8388608 then 'too-large' else 'ooxml' end)
  when not {_TEXTUAL} then (case when kind_of = '' and ext = '' then 'unknown-type' else 'unsupported-type' end)
  when {size} > 2097152 then 'too-large' else 'text' end as why from ext)"""


ORACLE["file_extensions"] = f"with {SEEDED}, {_FILES}, {_WITH_EXT} select file_id, ext from ext"
ORACLE["classified_files"] = (
    f"with {SEEDED}, {_FILES}, {_WITH_EXT}, {_classified('size * (case when file_id % 7 = 0 then 5000 else 1 end)')} "
    "select file_id, why in ('text', 'ooxml') as scannable, "
    "case when why in ('text', 'ooxml') then why else 'none' end as kind, why as reason from classes"
)
ORACLE["upload_decisions"] = f"""
with recursive {SEEDED}, {_FILES}, {_WITH_EXT}, {_classified('size')}, {redacted('seeded', 'doc_id')},
d as (select c.*, r.red, case when why not in ('text', 'ooxml') then 'upload-unscannable' when file_id % 13 = 0 then 'upload-unreadable'
  when file_id % 17 = 0 then {lit(UNVERIFIED_REASON)} when r.matched <> '' then 'pii-redacted' else 'no-pii' end as r2
  from classes c join red r on r.key = c.file_id)
select file_id, case r2 when 'pii-redacted' then 'replace' when 'no-pii' then 'allow' else 'block' end as action, r2 as reason,
  case when r2 = 'upload-unscannable' then why end as detail, case when r2 = 'pii-redacted' then red end as text from d
"""
_LINES = (
    "lines as (select row_number() over () as lid, doc_id, text from "
    "(select doc_id, unnest(string_split(text, chr(10))) as text from seeded) where text <> '')"
)
ORACLE["office_paragraphs"] = (
    f"with recursive {SEEDED}, {_LINES}, {redacted('lines', 'lid')} "
    "select l.doc_id as file_id, r.red as text, r.matched from red r join lines l on l.lid = r.key where r.matched <> ''"
)
ORACLE["redacted_files"] = f"""
with recursive {SEEDED}, {_FILES}, {_WITH_EXT}, {_classified('size')}, {redacted('seeded', 'doc_id')}, {_LINES},
{kept_spans('lines', 'lid', prefix='l_')},
doc_rules as (select doc_id, rule, count(*) as c from l_kept join lines on lid = key group by all),
office as (select s.doc_id, coalesce(string_agg(rule || '=' || c, ',' order by rule), '') as matched
  from seeded s left join doc_rules using (doc_id) group by s.doc_id)
select c.file_id, case when why = 'ooxml' then 'block' when why <> 'text' then 'block' when r.matched <> '' then 'replace' else 'allow' end as action,
  case when why = 'ooxml' then 'upload-unreadable' when why <> 'text' then 'upload-unscannable' when r.matched <> '' then 'pii-redacted' else 'no-pii' end as reason,
  case when why = 'ooxml' then 'not a readable Office file' when why <> 'text' then why end as detail,
  case when why = 'text' and r.matched <> '' then r.red end as text,
  case when why = 'text' then r.matched end as matched
from classes c join red r on r.key = c.file_id
union all
select -doc_id - 1, case when doc_id % 11 in (3, 5) or doc_id % 11 <> 7 and matched <> '' then 'block' else 'allow' end,
  case when doc_id % 11 in (3, 5) then 'upload-unreadable' when doc_id % 11 = 7 then 'no-text'
    when matched <> '' then 'pii-not-rewritten' else 'no-pii' end,
  case when doc_id % 11 in (3, 5) then 'not a readable Office file' end, null,
  case when doc_id % 11 not in (3, 5, 7) then matched end from office
"""
ORACLE["endpoint_sites"] = r"""
with u as (select page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) as h, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) as p from pages)
select page_id, array_to_string(list_filter([
  case when h = 'example.com' or h like '%.example.com' then 'com' end,
  case when contains(p, '/fr/') then 'fr' end,
  case when (h = 'example.net' or h like '%.example.net') and contains(p, '/en/') then 'net' end], lambda x: x is not null), ',') as sites,
  contains(url, '/de/') or contains(url, 'blog.') as holds from u
"""
