"""Statements for the prompt, command and code guards."""

from __future__ import annotations

from guardlake.fixed import code as code_values
from guardlake.fixed import commands as command_values
from guardlake.fixed import prompts as prompt_values
from guardlake.plans import samples
from oracle.parts import CODE, COMMANDS, PROMPTS, array, has, kept_spans, lit, pick, re2, trim

ORACLE = {}

# --- prompts ----------------------------------------------------------------------------------------


def _any(text: str, patterns) -> str:
    return "(" + " or ".join(has(text, p, f) for p, f in patterns) + ")"


_P = f"{PROMPTS}, t as (select *, {trim('prompt')} as p from prompts)"
_words = f"len(regexp_split_to_array(p, {lit(re2(chr(92) + 's+'))}))"
_trivial = (
    f"(p = '' or (length(p) <= 160 and {_words} <= 24 and not {_any('p', prompt_values.CODE_OR_DATA_SHAPES)} "
    f"and not {has('p', prompt_values.ACTION_WORDS, 'i')} and {has('p', prompt_values.FACTUAL_SHAPE, 'i')}))"
)
ORACLE["prompt_shapes"] = (
    f"with {_P} select conv_id, turn, {_any('prompt', prompt_values.CODE_OR_DATA_SHAPES)} as code_or_data, "
    f"{has('prompt', prompt_values.ACTION_WORDS, 'i')} as action_verb, "
    f"{has('prompt', prompt_values.FACTUAL_SHAPE, 'i')} as factual, {_trivial} as trivial from t"
)


def _known(text: str) -> str:
    whens = " ".join(
        f"when {has(text, p, 'i')} then {array(c)}" for p, c in prompt_values.INJECTION_SIGNATURES
    )
    return f"(case {whens} end)"


ORACLE["known_injections"] = (
    f"with {PROMPTS} select conv_id, turn, array_to_string({_known('prompt')}, ',') as categories from prompts"
)

# What each sample reply must parse to, worked out by hand: usable, risk, categories, confidence.
_VERDICTS = [
    (True, True, ["sql_injection"], 0.9),
    (True, True, ["xss"], 1.0),
    (True, False, [], 0.2),
    (True, False, ["ssrf"], 0.0),
    None,
    None,
    (True, True, [], 0.0),
    (True, True, ["idor", "idor"], 0.0),
]
assert len(_VERDICTS) == len(samples.VERDICT_REPLIES)


def _verdict_rows() -> str:
    rows = []
    for i, v in enumerate(_VERDICTS):
        if v is None:
            rows.append(f"({i}, false, NULL::boolean, NULL::varchar[], NULL::double)")
        else:
            cats = array(v[2]) + "::varchar[]"
            rows.append(f"({i}, true, {str(v[1]).lower()}, {cats}, {v[3]}::double)")
    return "v(k, usable, risk, cats, conf) as (values " + ", ".join(rows) + ")"


_J = f"{_P}, {_verdict_rows()}, j as (select t.*, v.* from t join v on v.k = length(prompt) % {len(_VERDICTS)})"
ORACLE["parsed_verdicts"] = (
    f"with {_J} select conv_id, turn, usable, risk, array_to_string(cats, ',') as categories, conf as confidence from j"
)
_labels = array(list(prompt_values.GUIDANCE))
ORACLE["valid_categories"] = (
    f"select event_id, array_to_string(list_filter([event_type, 'xss', {pick(['idor', 'nope', 'xss'], 'user_id')}], "
    f"lambda c: list_contains({_labels}, c)), ',') as categories from events"
)
# Equal prompts share one verdict, as they have the same length. Prompts that the first tier settles get none.
ORACLE["attached_verdicts"] = f"""
with {_J}, a as (select *, {_trivial} as triv, {_known('prompt')} as known from j)
select conv_id, turn, case when not triv and known is null then risk end as risk, case when not triv and known is null then conf end as confidence from a
"""
_A = f"""{_J}, a as (select *, {_trivial} as triv, {_known('prompt')} as known from j),
r as (select conv_id, turn, prompt,
  case when triv then 'allow' when known is not null then 'inject' when usable and risk and len(cats) > 0 then 'inject' else 'allow' end as verdict,
  case when triv then []::varchar[] when known is not null then known when usable and risk and len(cats) > 0 then cats else []::varchar[] end as cats,
  case when triv then 0.0 when known is not null then 0.99 when usable then conf else 0.0 end::double as confidence,
  case when triv or known is not null then 1 else 2 end as tier from a)"""
ORACLE["analyzed_prompts"] = (
    f"with {_A} select conv_id, turn, verdict, array_to_string(cats, ',') as categories, confidence, tier, false as blocked from r"
)
ORACLE["prompt_triage"] = (
    f"with {_P}, a as (select {_trivial} as triv, {_known('prompt')} as known from t) "
    "select case when not triv and known is not null then 'inject' else 'allow' end as verdict, 1 as tier, count(*) as n from a group by all"
)
_guide_rows = ", ".join(
    f"({i}, {lit(c)}, {lit(a)}, {lit(t)})" for i, (c, (a, t)) in enumerate(prompt_values.GUIDANCE.items())
)
_G = f"{_A}, g(place, category, action, text) as (values {_guide_rows})"
# Distinct categories of a verdict in order.
_D = (
    f"{_G}, c as (select conv_id, turn, cat, min(i) as i from (select conv_id, turn, unnest(cats) as cat, "
    "unnest(range(1, len(cats) + 1)) as i from r) group by all)"
)
ORACLE["guidance_use"] = (
    f"with {_D} select g.category, g.action, g.text, (select count(*) from c where c.cat = g.category) as n from g"
)
ORACLE["template_ids"] = (
    f"with {_D} select r.conv_id, r.turn, coalesce(string_agg(cat, ',' order by i), '') as template_ids, false as has_block "
    "from r left join c using (conv_id, turn) group by all"
)
_TEXT = (
    f"{_D}, gt as (select r.conv_id, r.turn, any_value(r.verdict) as verdict, "
    f"coalesce({lit(prompt_values.GUIDANCE_PREFIX)} || chr(10) || {lit(prompt_values.GUIDANCE_INTRO)} || chr(10) || "
    "string_agg('- ' || g.text, chr(10) order by c.i), '') as guidance "
    "from r left join c using (conv_id, turn) left join g on g.category = c.cat group by r.conv_id, r.turn)"
)
ORACLE["guidance_texts"] = f"with {_TEXT} select conv_id, turn, guidance from gt"
ORACLE["injected_guidance"] = f"""
with {_TEXT}, k as (select *, conv_id % 3 as prov, (conv_id // 3) % 3 as kind from gt)
select conv_id, turn, case
  when guidance = '' then (case when prov = 0 then (case kind when 0 then 'Be kind.' when 1 then 'Old.' end)
    when prov = 1 then (case kind when 0 then null end)
    else (case kind when 0 then 'Old.' end) end)
  when prov = 0 then (case kind when 0 then 'Be kind.' || chr(10) || chr(10) || guidance else guidance end)
  when prov = 1 then guidance
  else (case kind when 0 then 'Old.' || chr(10) || chr(10) || guidance else guidance end) end as system,
  guidance = '' as same from k
"""

# --- commands ---------------------------------------------------------------------------------------

# RE2 has no look-around: each such pattern is written as tests that need none.
_RM, _END = r"\brm\s+(?:[^\n]*\s)?-[a-z]*", r"\b"
_FORCE = r"\bgit\s+push\b[^\n]*--force(?:[^-]|-[^w]|$)"
_LOOK = {
    r"\brm\s+(?=(?:[^\n]*\s)?-[a-z]*r\b)(?=(?:[^\n]*\s)?-[a-z]*f\b)": lambda t: (
        f"({has(t, _RM + 'r' + _END, 'i')} and {has(t, _RM + 'f' + _END, 'i')})"
    ),
    r"\bgit\s+push\b[^\n]*--force(?!-with-lease)": lambda t: (
        f"({has(t, _FORCE, 'i')})"
    ),
    r"\.innerHTML\s*=(?!=)": lambda t: has(t, r"\.innerHTML\s*=(?:[^=]|$)"),
}


def _test(text: str, pattern: str, flags: str) -> str:
    return _LOOK[pattern](text) if pattern in _LOOK else has(text, pattern, flags)


for _entry in command_values.COMMAND_CATEGORIES:
    _hit = " or ".join(_test("command", p, f) for p, f in _entry["patterns"])
    ORACLE[f"command_{_entry['category']}"] = f"with {COMMANDS} select doc_id, {_hit} as hit from commands"


def _first(column: str, value) -> str:
    whens = []
    for entry in command_values.COMMAND_CATEGORIES:
        for pattern, flags in entry["patterns"]:
            whens.append(f"when {_test('command', pattern, flags)} then {value(entry, pattern)}")
    default = {"permission": "'allow'", "user_message": "''", "agent_message": "''"}.get(column, "NULL")
    return f"(case when {trim('command')} = '' then {default} {' '.join(whens)} else {default} end) as {column}"


_VERDICT = ", ".join(
    [
        _first("permission", lambda e, p: lit(e["permission"])),
        _first("category", lambda e, p: lit(e["category"])),
        _first("matched_pattern", lambda e, p: lit(p)),
        _first("user_message", lambda e, p: lit(e["user_message"])),
        _first("agent_message", lambda e, p: lit(e["agent_message"])),
    ]
)
ORACLE["command_verdicts"] = (
    f"with {COMMANDS}, c as (select doc_id, 'whole' as form, command from commands "
    "union all select doc_id, 'broken', ' ' || chr(10) from commands where doc_id % 19 = 0) "
    f"select doc_id, form, {_VERDICT} from c"
)
_GUARDED = f"{COMMANDS}, cv as (select doc_id, {_VERDICT} from commands)"
ORACLE["guarded_commands"] = (
    f"with {_GUARDED} select doc_id, 'whole' as form, permission, category, user_message from cv where permission <> 'allow' "
    f"union all select doc_id, 'broken', 'deny', null, {lit(command_values.UNREADABLE_USER_MESSAGE)} from commands where doc_id % 23 = 0"
)
_cat_rows = ", ".join(
    f"({i}, {lit(e['category'])}, {lit(e['permission'])})"
    for i, e in enumerate(command_values.COMMAND_CATEGORIES)
)
ORACLE["command_category_use"] = (
    f"with {_GUARDED}, t(place, category, permission) as (values {_cat_rows}) "
    "select t.*, (select count(*) from cv where cv.category = t.category) as n from t"
)
_NORMAL_CATS = (
    f"{_TEXT}, {_GUARDED}, m as (select 'total' as metric from r where verdict <> 'allow' "
    "union all select 'injected' from gt where verdict <> 'allow' and guidance <> '' "
    "union all select 'category:' || unnest(cats) from r where verdict <> 'allow'), "
    "rs as (select metric, count(*) as n from m group by metric)"
)
ORACLE["risk_summary"] = f"with {_NORMAL_CATS} select metric, n from rs"
ORACLE["top_risks"] = (
    f"with {_NORMAL_CATS} select metric, n from rs where metric like 'category:%' order by n desc, metric limit 4"
)
ORACLE["rule_eval"] = f"""
with recursive {kept_spans('documents', 'doc_id')},
d as (select doc_id, n_chars, doc_id in (select key from kept) as pii from documents),
x as (select case when quality = 0 then 'inject' else 'allow' end as expected,
  case when n_chars < 100 then 'ERROR' when pii then 'inject' else 'allow' end as got from labels join d using (doc_id))
select count(*) as cases, count(*) filter (got = expected) as correct, count(*) filter (expected <> 'allow') as risky,
  count(*) filter (expected <> 'allow' and got = expected) as caught, count(*) filter (expected = 'allow') as benign,
  count(*) filter (expected = 'allow' and got not in ('allow', 'ERROR')) as false_positives,
  count(*) filter (got = 'ERROR') as errors from x
"""
ORACLE["security_log"] = f"""
with {_TEXT}, {_GUARDED}, @FINDINGS@,
fa as (select conv_id, file_path, count(*) as n_findings from findings group by all)
select 'prompt-guard' as kind, 'cursor-hook' as surface, verdict, null as permission, null as command_category, count(*) as n, null::bigint as n_findings
  from gt where verdict <> 'allow' group by verdict
union all select 'command-guard', 'claude-code', null, permission, category, count(*), null from cv where permission <> 'allow' group by permission, category
union all select 'action-guard', 'claude-code', null, null, null, count(*), sum(n_findings)::bigint from fa having count(*) > 0
union all select 'action-guard-error', 'cursor', null, null, null, count(*), null from documents where doc_id % @REPLIES@ not in (0, 1, 2, 5) having count(*) > 0
"""

# --- code -------------------------------------------------------------------------------------------


def _trips(entry) -> str:
    hit = "(" + " or ".join(_test("line", p, f) for p, f in entry["patterns"]) + ")"
    if entry["category"] == "hardcoded_secret":
        hit += f" and not {has('line', code_values.SECRET_PLACEHOLDER, 'i')}"
    return f"({hit})"


_CODE_LINES = (
    f"{CODE}, parts as (select doc_id, conv_id, file_path, regexp_split_to_array(content, '\\r?\\n') as ls from code), "
    "lines as (select doc_id, conv_id, file_path, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as no from parts)"
)
for _entry in code_values.CODE_CATEGORIES:
    ORACLE[f"code_{_entry['category']}"] = (
        f"with {_CODE_LINES} select doc_id, no as line from lines where {_trips(_entry)}"
    )
_all = " union all ".join(
    f"select doc_id, conv_id, file_path, 1 as tier, {lit(e['category'])} as category, {lit(e['message'])} as message, no as line "
    f"from lines where {trim('line')} <> '' and {_trips(e)}"
    for e in code_values.CODE_CATEGORIES
)
FINDINGS = f"{_CODE_LINES}, findings as ({_all})"
ORACLE["security_log"] = (
    ORACLE["security_log"].replace("@FINDINGS@", FINDINGS).replace("@REPLIES@", str(len(samples.FINDING_REPLIES)))
)
ORACLE["code_findings"] = f"with {FINDINGS} select doc_id, tier, category, message, line from findings"
_secret = next(e for e in code_values.CODE_CATEGORIES if e["category"] == "hardcoded_secret")
ORACLE["hardcoded_secrets"] = (
    "with parts as (select doc_id, regexp_split_to_array(text, '\\r?\\n') as ls from documents), "
    "lines as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as no from parts) "
    f"select doc_id, no as line from lines where {_trips(_secret)}"
)
# What each sample reply must parse to, worked out by hand.
_FOUND = {
    0: ("missing_auth", "No check.", "3"),
    1: ("idor", "Owner.", "NULL"),
    5: ("xss", "Escape.", "NULL"),
}
_found_rows = ", ".join(f"({k}, {lit(c)}, {lit(m)}, {n}::bigint)" for k, (c, m, n) in _FOUND.items())
_n = len(samples.FINDING_REPLIES)
_MODEL = f"mf(k, category, message, line) as (values {_found_rows})"
ORACLE["parsed_findings"] = (
    f"with {_MODEL} select doc_id, doc_id % {_n} in (0, 1, 2, 5) as usable, "
    "case when category is not null then 2 end as tier, category, message, line "
    f"from documents left join mf on k = doc_id % {_n}"
)
ORACLE["merged_findings"] = f"""
with {FINDINGS}, {_MODEL},
u as (select conv_id, file_path, category, message, line, tier from findings
  union all select conv_id, file_path, category, message, line, 2 from findings where line % 2 = 0
  union all select c.conv_id, c.file_path, mf.category, mf.message, mf.line, 2 from code c join mf on k = doc_id % {_n})
select conv_id, file_path, category, line, message, min(tier) as tier from u group by all
"""
_ACC = f"""{FINDINGS}, dist as (select conv_id, category, line, message, min(doc_id) as seen from findings group by all),
acc as (select *, row_number() over (partition by conv_id order by seen, category, line, message) as nth from dist)"""
ORACLE["accumulated_findings"] = f"with {_ACC} select conv_id, nth, category, message, line from acc"
ORACLE["pending_messages_text"] = (
    f"with {_ACC} select conv_id, count(*) as n, {lit(code_values.PENDING_HEADER)} || "
    "string_agg('- [' || category || '] line ' || line || ': ' || message, chr(10) order by nth) as message from acc group by conv_id"
)
ORACLE["finding_audit"] = (
    f"with {FINDINGS} select file_path, count(*) as n_findings, "
    "string_agg(line || ':' || category, ',' order by line, category) as findings from findings group by file_path"
)
ORACLE["finding_files"] = (
    f"with {FINDINGS}, f as (select conv_id, file_path, count(*) as n from findings group by all) "
    "select conv_id, count(*) as n_files, sum(n)::bigint as n_findings from f group by conv_id"
)
# Equal findings of one file count once.
ORACLE["pending_findings_stream"] = (
    f"with {FINDINGS} select file_path, count(*) as n from (select distinct file_path, category, line, message from findings) "
    "group by file_path"
)
