"""Building blocks of the DuckDB statements."""

from __future__ import annotations

import re

from guardlake.fixed.pii import PII_PATTERNS, VERHOEFF_PERMUTATION
from guardlake.plans import samples

_TOKEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|[\s\S]")
_SPACE = r"\s\x{000B}\p{Z}\x{FEFF}"


def re2(source: str, flags: str = "") -> str:
    """A JavaScript-dialect pattern without look-around, for RE2."""
    out = []
    for token in _TOKEN.findall(source):
        if token == r"\s":
            token = f"[{_SPACE}]"
        elif token.startswith("[") and token != r"[\s\S]":
            token = token.replace(r"\s", _SPACE)
        elif token == "$":
            token = r"\z"
        out.append(token.replace(r"\/", "/"))
    return ("(?i)" if "i" in flags else "") + "".join(out)


def lit(text) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def array(items) -> str:
    return "[" + ", ".join(i if isinstance(i, str) and i.startswith("@") else lit(i) for i in items) + "]"


def pick(items, by: str) -> str:
    """Element number ``by`` modulo the length of a literal list."""
    return f"list_extract({array(items)}, (({by}) % {len(items)})::int + 1)"


def has(text: str, source: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {lit(re2(source, flags))})"


def trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


SEEDED = f"seeded as (select doc_id, source, text || chr(10) || {pick(samples.PII, 'doc_id')} as text from documents)"

_by = "conv_id + turn"
PROMPTS = (
    f"prompts as (select conv_id, turn, {pick([b for b, _ in samples.PROMPTS], _by)} || text || "
    f"{pick([a for _, a in samples.PROMPTS], _by)} as prompt from conversations where role = 'user')"
)
COMMANDS = f"commands as (select doc_id, {pick(samples.COMMANDS, 'doc_id')} || ' ' || text as command from documents)"
CODE = (
    "code as (select doc_id, source as conv_id, 'src/f' || doc_id || '.py' as file_path, text || "
    "(case when doc_id % 2 = 0 then chr(10) else chr(13) || chr(10) end) || "
    f"{pick(samples.CODE_LINES, 'doc_id')} as content from documents)"
)
DECISIONS = (
    "decisions as (select event_id, ts, (epoch_us(ts) // 1000) as ms, "
    f"{pick(samples.SURFACE_NAMES, 'user_id')} as surface, "
    "case when event_type = 'view' then 'incoming' else 'outgoing' end as direction, "
    "case event_type when 'error' then 'blocked' when 'purchase' then 'redacted' else 'allowed' end as decision, "
    "case floor(value)::bigint % 3 when 1 then ['EMAIL'] when 2 then ['EMAIL', 'IPV4'] else []::varchar[] end as pii_types, "
    "floor(value * 10)::bigint as latency_ms from events)"
)
NOW_MS = 1706659200000


def luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    digit = f"substr({d}, length({d}) - i::int, 1)::int"
    return (
        f"(length({d}) between 13 and 19 and list_sum(list_transform(range(0, length({d})), lambda i: "
        f"case when i % 2 = 1 then (case when 2 * {digit} > 9 then 2 * {digit} - 9 else 2 * {digit} end) "
        f"else {digit} end)) % 10 = 0)"
    )


def verhoeff(v: str) -> str:
    """Tables written out from the group rule; list positions start at one."""

    def product(a: int, b: int) -> int:
        turn = a + b if a < 5 else a - b
        return turn % 5 if (a < 5) == (b < 5) else 5 + turn % 5

    d_table = [product(a, b) for a in range(10) for b in range(10)]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([rows[-1][x] for x in VERHOEFF_PERMUTATION])
    p_table = [x for row in rows for x in row]
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    steps = (
        f"list_transform(range(0, 12), lambda i: ({p_table})[(i % 8) * 10 + substr({d}, 12 - i::int, 1)::int + 1])"
    )
    return (
        f"(length({d}) = 12 and list_reduce(list_prepend(0, {steps}), lambda c, p: ({d_table})[c * 10 + p + 1]) = 0)"
    )


def public_ipv4(v: str) -> str:
    return f"(try_cast(split_part({v}, '.', 1) as int) <> 127)"


def public_ipv6(v: str) -> str:
    g = f"list_filter(string_split({v}, ':'), lambda g: g <> '')"
    zeros = f"len(list_filter(({g})[1:len({g}) - 1], lambda z: not regexp_full_match(z, '0+'))) = 0"
    return f"(len({g}) > 0 and not ({zeros} and regexp_full_match(({g})[len({g})], '0*1?')))"


CHECKS = {"CREDIT_CARD": luhn, "AADHAAR": verhoeff, "IPV4": public_ipv4, "IPV6": public_ipv6}
DEFAULT = [(n, re2(p, f), CHECKS.get(n)) for n, p, f in PII_PATTERNS]


def good_spans(src: str, key: str, rules=DEFAULT, extra: str = "", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}good`` (key, text, rule, rnk, s, e, v): every accepted match."""
    hits = " union all ".join(
        f"select {key} as key, text, {lit(name)} as rule, {rank} as rnk, "
        f"regexp_split_to_array(text, {lit(p)}) as g, regexp_extract_all(text, {lit(p)}) as m "
        f"from {src} where regexp_matches(text, {lit(p)})"
        for rank, (name, p, _) in enumerate(rules)
    )
    checks = " and ".join(
        [f"(rule <> {lit(n)} or {check('v')})" for n, _, check in rules if check] or ["true"]
    )
    return f"""{prefix}hits as ({hits}),
{prefix}pos as (select key, text, rule, rnk, m[i] as v,
  (list_sum(list_transform(g[1:i], lambda x: length(x)))
   + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as s
  from {prefix}hits, unnest(range(1, len(m) + 1)) as t(i)),
{prefix}good as (select key, text, rule, rnk, s, s + length(v) as e, v from {prefix}pos where {checks} {extra})"""


def kept_spans(src: str, key: str, rules=DEFAULT, extra: str = "", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}kept`` (key, n, rule, s, e): spans after overlaps are settled."""
    return good_spans(src, key, rules, extra, prefix) + f""",
{prefix}settle as (
  select distinct key, 0::bigint as n, ''::varchar as rule, 0::bigint as s, 0::bigint as e from {prefix}good
  union all
  select key, n + 1, b.rule, b.s, -b.back from (
    select st.key, st.n, min(struct_pack(s := g.s, back := -g.e, rnk := g.rnk, rule := g.rule)) as b
    from {prefix}settle st join {prefix}good g on g.key = st.key and g.s >= st.e group by st.key, st.n)),
{prefix}kept as (select key, n, rule, s, e from {prefix}settle where n > 0)"""


def redacted(src: str, key: str, direction: str = "inbound", rules=DEFAULT, extra: str = "", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}red`` (key, text, red, matched) for every row of ``src``."""
    token = "'[REDACTED_PII_' || rule || ']'" if direction == "inbound" else "'[REDACTED_MOCK_PII]'"
    return kept_spans(src, key, rules, extra, prefix) + f""",
{prefix}gaps as (select k.*, coalesce(lag(e) over (partition by key order by s), 0) as prev from {prefix}kept k),
{prefix}new as (select g.key, string_agg(substr(d.text, prev + 1, s - prev) || {token}, '' order by s) as head,
   max(e) as last from {prefix}gaps g join {src} d on d.{key} = g.key group by g.key),
{prefix}cnt as (select key, string_agg(rule || '=' || c, ',' order by rule) as matched
   from (select key, rule, count(*) as c from {prefix}kept group by all) group by key),
{prefix}red as (select d.{key} as key, d.text, coalesce(n.head || substr(d.text, n.last + 1), d.text) as red,
   coalesce(c.matched, '') as matched
   from {src} d left join {prefix}new n on n.key = d.{key} left join {prefix}cnt c on c.key = d.{key})"""
