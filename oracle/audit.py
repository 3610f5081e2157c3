"""Statements for decision analytics, configuration, sinks and streams."""

from __future__ import annotations

from guardlake.fixed.traffic import DEFAULT_MODES, SURFACES
from guardlake.plans import samples
from oracle.parts import DECISIONS, NOW_MS, SEEDED, lit, pick, redacted

ORACLE = {}
_DAY = 86_400_000
_RANGE = {"today": _DAY, "7d": 7 * _DAY, "30d": 30 * _DAY}


def _since(name: str) -> str:
    return f"ms >= {NOW_MS - _RANGE[name]}"


_COUNTS = (
    "count(*) as total, count(*) filter (decision = 'redacted') as redactions, "
    "count(*) filter (decision = 'blocked') as blocks"
)
ORACLE["range_starts"] = (
    f"with {DECISIONS} select event_id, ms - {_DAY} as today, ms - {7 * _DAY} as d7, ms - {30 * _DAY} as d30, "
    f"ms - {7 * _DAY} as other from decisions"
)
ORACLE["decision_totals"] = (
    f"with {DECISIONS} select {_COUNTS} from decisions where {_since('30d')} and surface = 'gemini'"
)
ORACLE["decision_totals_blocked"] = (
    f"with {DECISIONS} select {_COUNTS} from decisions where {_since('7d')} and decision = 'blocked'"
)
ORACLE["volume_cards"] = (
    f"with {DECISIONS} select count(*) filter ({_since('today')}) as today, count(*) filter ({_since('7d')}) as d7, "
    f"count(*) filter ({_since('30d')}) as d30 from decisions"
)


def _series(name: str, width: int) -> str:
    return f"select ms // {width} * {width} as bucket, decision, count(*) as n from decisions where {_since(name)} group by all"


ORACLE["decision_series"] = f"with {DECISIONS} {_series('30d', _DAY)}"
ORACLE["decision_series_today"] = f"with {DECISIONS} {_series('today', 3_600_000)}"
_TYPES = f"select type, count(*) as n from (select unnest(pii_types) as type from decisions where {_since('30d')}) group by type"
ORACLE["pii_breakdown"] = f"with {DECISIONS} {_TYPES}"
ORACLE["top_rules"] = f"with {DECISIONS} {_TYPES} order by n desc, type limit 14"
_SURF = (
    "select surface, count(*) as volume, count(*) filter (decision = 'blocked') as blocks, "
    f"count(*) filter (decision = 'redacted') as redactions, max(ms) as last_seen from decisions where {_since('7d')} group by surface"
)
ORACLE["per_surface"] = f"with {DECISIONS} {_SURF}"
ORACLE["surface_health"] = (
    f"with {DECISIONS}, s as ({_SURF}) select surface, volume, floor(blocks * 100 / volume + 0.5)::int as block_pct, "
    "floor(redactions * 100 / volume + 0.5)::int as redaction_pct, "
    f"case when {NOW_MS} - last_seen > 3600000 then 'stale' else 'active' end as health from s"
)
ORACLE["series_pivot"] = (
    f"with {DECISIONS}, s as ({_series('30d', _DAY)}) select bucket, coalesce(sum(n) filter (decision = 'allowed'), 0)::bigint as allowed, "
    "coalesce(sum(n) filter (decision = 'blocked'), 0)::bigint as blocked, "
    "coalesce(sum(n) filter (decision = 'redacted'), 0)::bigint as redacted from s group by bucket"
)
ORACLE["recent_events"] = (
    f"with {DECISIONS} select event_id, ms as ts, surface, decision from decisions "
    f"where {_since('30d')} and decision = 'redacted' order by decisions.ts desc, event_id desc limit 200"
)
ORACLE["recent_traffic"] = (
    f"with {DECISIONS}, n as (select event_id as id, ts, len(pii_types) > 0 as pii from decisions) "
    "select id from n where pii order by ts desc, id desc limit 40"
)
ORACLE["inspector_stats"] = (
    f"with {DECISIONS} select count(*) as entries, count(*) filter (len(pii_types) > 0) as pii_entries from decisions"
)
ORACLE["latency_stats"] = (
    f"with {DECISIONS} select surface, count(*) as n, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95 "
    "from decisions group by surface"
)

# --- configuration ----------------------------------------------------------------------------------

PATCHES = f"""patches as (select event_id as seq, ts, (epoch_us(ts) // 1000) as ms, {pick([*samples.SURFACE_NAMES, 'teams'], 'user_id')} as surface,
  {pick(['redact', 'block', 'off', 'allow', None], 'event_id')} as mode, case event_id % 4 when 0 then true when 2 then false end as enabled,
  'admin' || (user_id % 5) as admin from events)"""
_CATALOG = "catalog(surface) as (values " + ", ".join(f"({lit(s)})" for s, _ in SURFACES) + ")"
CURRENT = f"""{PATCHES}, {_CATALOG}, latest as (select surface, arg_max(mode, seq) filter (mode is not null) as mode,
  arg_max(enabled, seq) filter (enabled is not null) as enabled, arg_max(admin, seq) as admin, arg_max(ms, seq) as ms from patches group by surface),
config as (select c.surface, coalesce(enabled, true) as enabled, coalesce(mode, case when c.surface = 'cursor' then 'block' else 'redact' end) as mode,
  'closed' as fail_mode, coalesce(admin, 'system') as updated_by, ms as updated_at from catalog c left join latest l on l.surface = c.surface)"""
ORACLE["current_config"] = f"with {CURRENT} select * from config"
ORACLE["config_upserts"] = f"""
with {CURRENT}, p as (select surface, arg_max(struct_pack(enabled := enabled, admin := admin), seq) as r from patches where surface <> 'grok' group by surface)
select coalesce(c.surface, p.surface) as surface, coalesce(p.r.enabled, c.enabled, true) as enabled,
  case when p.surface is not null then 'block' else c.mode end as mode, coalesce(p.r.admin, c.updated_by) as updated_by,
  case when p.surface is not null then coalesce(c.mode, 'redact') end as before_mode, case when p.surface is not null then 'block' end as after_mode,
  p.r.admin as admin from config c full outer join p on p.surface = c.surface
"""
_known = "(" + ", ".join(lit(s) for s, _ in SURFACES) + ")"
_redact_modes = ", ".join(DEFAULT_MODES)
ORACLE["refused_modes"] = f"""
with {PATCHES} select seq, surface, mode, case when surface not in {_known} then 'unknown surface "' || surface || '"'
  when surface = 'cursor' and mode not in ('block', 'allow') then 'mode "' || mode || '" not valid for cursor (allowed: block, allow)'
  when surface <> 'cursor' and mode not in ('redact', 'block', 'off') then 'mode "' || mode || '" not valid for ' || surface || ' (allowed: {_redact_modes})' end as error
from patches
"""
ORACLE["config_version"] = f"with {PATCHES} select count(*) as version from patches"
_AUDIT = f"{PATCHES}, audit as (select *, case when seq % 3 = 0 then 'rules.update' else 'surface_config.update' end as action from patches)"
ORACLE["audit_view"] = (
    f"with {_AUDIT} select seq as audit_id, surface as target from audit where admin = 'admin3' and action = 'surface_config.update' "
    "and epoch_us(ts) between 1704499200000000 and 1705708800000000 order by ts desc, seq desc limit 50"
)
ORACLE["audit_log_files"] = (
    f"with {_AUDIT} select action, surface as target, count(*) as n from audit where admin = 'admin1' group by all"
)

# Attempts of a user in order, carrying the times admitted in the last three days.
ORACLE["rate_limited_users"] = """
with recursive o as (select event_id, user_id, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id order by ts, event_id) as nth from events),
s as (
  select user_id, nth, event_id, true as admitted, [ms] as held from o where nth = 1
  union all
  select user_id, nth, event_id, len(held) < 2, case when len(held) < 2 then list_append(held, ms) else held end
  from (select o.user_id, o.nth, o.event_id, o.ms, list_filter(s.held, lambda t: o.ms - t < 259200000) as held
    from s join o on o.user_id = s.user_id and o.nth = s.nth + 1)
)
select event_id as attempt_id, user_id as key, admitted from s
"""

# --- sources and sinks ------------------------------------------------------------------------------

ORACLE["read_texts"] = (
    "select lang, count(*) as n, sum(length(text))::bigint as n_chars from documents group by lang"
)
ORACLE["read_transcripts"] = """
with l as (select conv_id, turn * 2 as ord, case when role = 'user' then length(text) + length('<timestamp>now</timestamp><user_query>') + length('</user_query>') + 2 else length(text) end as n_chars from conversations
  union all select conv_id, turn * 2 + 1, null from conversations where role = 'assistant')
select conv_id, row_number() over (partition by conv_id order by ord) - 1 as pos, n_chars from l
"""
ORACLE["read_files"] = "select page_id, strlen(html) + 1 as size, true as complete from pages"
_json = "case len(pii_types) when 0 then '[]' when 1 then '[\"EMAIL\"]' else '[\"EMAIL\",\"IPV4\"]' end"
_cell = (
    "case len(pii_types) when 0 then '[],' when 1 then '\"[\"\"EMAIL\"\"]\",EMAIL' "
    "else '\"[\"\"EMAIL\"\",\"\"IPV4\"\"]\",\"EMAIL,IPV4\"' end"
)
ORACLE["event_csv_lines"] = f"""
with {DECISIONS} select event_id::varchar as id, event_id || ',' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((ms % 1000)::varchar, 3, '0') || 'Z,' ||
  surface || ',' || direction || ',' || decision || ',' || {_cell} || ',' || latency_ms as line from decisions
"""
ORACLE["event_csv_files"] = (
    f"with {DECISIONS} select surface, {_json} as pii_types, count(*) as n from decisions group by all"
)

# --- streams ----------------------------------------------------------------------------------------

ORACLE["parsed_sse"] = f"""
with {SEEDED}, x as (select * from seeded where (doc_id // 3) % 2 = 1)
select doc_id as id, 0 as at, 'x' as event, text as delta, false as terminal, false as block_stop from x
union all select doc_id, 1, null, null, true, false from x
"""
_OUT = (
    f"with recursive {SEEDED}, {redacted('seeded', 'doc_id', 'outbound')} select key as doc_id, red as text, matched from red"
)
ORACLE["stream_redact_batch"] = _OUT
ORACLE["stream_redact_sorted"] = _OUT
ORACLE["stream_redact"] = _OUT
ORACLE["reframed_stream"] = (
    f"with {SEEDED} select doc_id, 1 as n_done, 1 as n_start, 'length' as finish, text from seeded"
)
ORACLE["dedupe_turns_stream"] = (
    "select distinct conv_id, substr(sha256(case when role = 'assistant' then chr(0) || text else text || chr(0) end), 1, 32) as turn_hash "
    "from conversations"
)
ORACLE["series_stream"] = (
    f"with {DECISIONS} select ms // 3600000 * 3600000 as bucket, surface, decision, count(*) as n from decisions group by all"
)
