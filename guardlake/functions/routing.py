"""Requests: provider routing, headers, model policy and surface labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed import traffic as fixed
from guardlake.functions import payload
from guardlake.functions.expr import any_of, array_of, first_match, found, js_trim, let
from guardlake.functions.text import slug

ROUTE = "struct<provider:string,upstream_base:string,forward_path:string>"


def _literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]).cast("map<string,string>")


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last one counts."""
    entries = F.transform(
        F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"])
    )

    def latest(all_entries: Column) -> Column:
        names = F.transform(all_entries, lambda e: e["key"])

        def is_last(e: Column, i: Column) -> Column:
            return F.array_position(F.slice(names, i + 2, F.size(names)), e["key"]) == 0

        return F.map_from_entries(F.filter(all_entries, is_last))

    return let(entries, latest)


def is_loopback(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^\[|\]\z", "")
    return F.coalesce(
        (host == "localhost")
        | host.rlike(r"^127(?:\.[0-9]{1,3}){3}\z")
        | host.rlike(r"^(?:0*:)*0*1\z"),
        F.lit(False),
    )


def route_request(
    url: Column,
    headers: Column,
    upstreams: Mapping[str, str],
    allow_override: bool = False,
) -> Column:
    """Provider, upstream and forwarded path of a request; null where no tier decides.

    The tiers are path prefix, provider header, path shape and authentication headers.
    """
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)
    bases = _literal_map(upstreams)

    def route(where: Column, h: Column) -> Column:
        p, tail = where["path"], F.concat(where["path"], where["query"])

        def to(provider, forward: Column = tail) -> Column:
            name = provider if isinstance(provider, Column) else F.lit(provider)
            override = h["x-llm-upstream"]
            own = F.element_at(bases, name)
            base = F.when(is_loopback(override), override).otherwise(own) if allow_override else own
            slash = F.when(F.startswith(forward, F.lit("/")), "").otherwise("/")
            return F.struct(
                name.alias("provider"),
                F.regexp_replace(base, r"/+\z", "").alias("upstream_base"),
                F.concat(slash, forward).alias("forward_path"),
            )

        tiers = F.when(F.lit(False), F.lit(None).cast(ROUTE))
        for prefix, provider in fixed.PATH_PREFIXES:
            under = (p == prefix) | F.startswith(p, F.lit(prefix + "/"))
            rest = F.substring(tail, F.lit(len(prefix) + 1), F.length(tail))
            tiers = tiers.when(under, to(provider, rest))
        hint = F.lower(h["x-llm-provider"])
        tiers = tiers.when(hint.isin(fixed.PROVIDERS), to(hint))
        tiers = tiers.when(p.isin(fixed.ANTHROPIC_PATHS), to("anthropic"))
        gemini_path = any_of(F.startswith(p, F.lit(s)) for s in fixed.GEMINI_PATH_STARTS)
        tiers = tiers.when(gemini_path | found(p, fixed.GEMINI_CALLS), to("gemini"))
        tiers = tiers.when(p.isin(fixed.OPENAI_PATHS), to("openai"))
        has = {n: F.map_contains_key(h, n) for n in fixed.ANTHROPIC_HEADERS}
        tiers = tiers.when(any_of(has.values()), to("anthropic"))
        tiers = tiers.when(F.map_contains_key(h, fixed.GEMINI_KEY_HEADER), to("gemini"))
        bearer = found(h["authorization"], r"^Bearer\s", "i")
        versioned = F.startswith(p, F.lit("/v1/")) & ~p.isin(fixed.OPENAI_PATHS)
        return tiers.when(bearer & versioned, to("anthropic")).when(bearer, to("openai"))

    where = F.struct(
        F.when(path == "", "/").otherwise(path).alias("path"), query.alias("query")
    )
    safe = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    return let(where, lambda w: let(lower_keys(safe), lambda h: route(w, h)))


def forwardable_headers(headers: Column) -> Column:
    """Headers passed on: no hop-by-hop, control or proxy headers, and no compressed answers."""
    dropped = fixed.HOP_BY_HOP_HEADERS + fixed.CONTROL_HEADERS
    kept = F.map_filter(
        lower_keys(headers),
        lambda k, v: ~k.isin(dropped) & ~F.startswith(k, F.lit("proxy-")) & v.isNotNull(),
    )
    return F.map_concat(kept, F.create_map(F.lit("accept-encoding"), F.lit("identity")))


def extract_model(provider: Column, forward_path: Column, body: Column) -> Column:
    """Model id from a Gemini path, the JSON body, or the raw text of a broken body."""
    from_path = F.when(
        (provider == "gemini") & forward_path.rlike(r"/models/[^:/?]+"),
        F.regexp_extract(forward_path, r"/models/([^:/?]+)", 1),
    )
    from_json = payload.string_field(payload.parsed(body), "$.model")
    from_text = first_match(body, r'"model"\s*:\s*"([^"]+)"', group=1)
    return F.coalesce(from_path, from_json, from_text)


def model_policies(blocked: Sequence[str] = ()) -> list[dict]:
    """The policy list with stable ids; ``blocked`` names the ids to block."""
    entries = []
    for label, match in fixed.MODEL_POLICIES:
        entry_id = "-".join("".join(c if c.isalnum() else " " for c in label.lower()).split())
        entries.append(
            {"id": entry_id, "label": label, "match": match, "blocked": entry_id in blocked}
        )
    return entries


def model_blocked(model: Column, policies: Sequence[Mapping]) -> Column:
    lower = F.lower(model)
    hits = [
        F.contains(lower, F.lit(p["match"])) for p in policies if p["blocked"] and p["match"] != ""
    ]
    return F.coalesce(any_of(hits), F.lit(False))


def resolve_model(model: Column, aliases: Mapping[str, str], default: str) -> Column:
    """Alias first, then a real claude id as it is, then the default."""
    lower = F.lower(model)
    alias = F.element_at(_literal_map(aliases), lower) if aliases else F.lit(None)
    own = F.when(F.startswith(lower, F.lit("claude")), model)
    return F.coalesce(alias, own, F.lit(default))


def should_translate(model: Column, aliases: Sequence[str]) -> Column:
    lower = F.lower(model)
    named = lower.isin([a.lower() for a in aliases]) if aliases else F.lit(False)
    return F.coalesce((lower != "") & (F.startswith(lower, F.lit("claude")) | named), F.lit(False))


def surface_of(method: Column, path: Column, provider: Column) -> Column:
    """Dashboard surface of a traffic row."""
    p = F.coalesce(path, F.lit(""))
    site = r"^([a-z0-9]+)-web-extension\z"
    return (
        F.when((method == "HOOK") | F.startswith(p, F.lit("cursor")), "cursor")
        .when(p.rlike(site), F.regexp_extract(p, site, 1))
        .when(provider == "anthropic", "claude-code")
        .otherwise(F.coalesce(provider, F.lit("unknown")))
    )


def site_of_host(host: Column) -> Column:
    """Site of a host or one of its subdomains; unknown hosts count as the default site."""
    lower = F.lower(host)
    result = F.when(F.lit(False), F.lit(""))
    for site, hosts in fixed.SITES:
        matches = [(lower == h) | F.endswith(lower, F.lit("." + h)) for h in hosts]
        result = result.when(any_of(matches), site)
    return result.otherwise(fixed.DEFAULT_SITE)


def model_label(site: Column, label: Column) -> Column:
    """Log name of the model a site shows; the site's own name when the label says nothing."""
    flat = js_trim(F.regexp_replace(label, r"[\s\x{FEFF}\p{Z}]+", " "))

    def prefixed(name: str) -> Column:
        return F.when(found(flat, f"^{name}", "i"), slug(flat)).otherwise(
            F.concat(F.lit(name + "-"), slug(flat))
        )

    rest = js_trim(F.regexp_replace(flat, r"(?i)^chatgpt\s*", ""))
    chatgpt = F.when(found(flat, "^gpt", "i"), slug(flat)).when(
        rest != "", F.concat(F.lit("chatgpt-"), slug(rest))
    )
    tier = F.lower(first_match(label, fixed.GEMINI_TIERS, "i", 1))
    named = (
        F.when(site == "gemini", F.concat(F.lit("gemini-"), tier))
        .when(flat == "", None)
        .when(site == "chatgpt", chatgpt)
        .when(site == "grok", prefixed("grok"))
        .when(site == "deepseek", prefixed("deepseek"))
    )
    return F.coalesce(named, site)


def decide_send(ok: Column, redacted_text: Column, original: Column) -> Column:
    """Block when the scrub failed; else send the redacted text, or the original if none came back."""
    sent = F.struct(
        F.lit("submit").alias("action"),
        F.coalesce(redacted_text, original).alias("text"),
        F.lit(None).cast("string").alias("reason"),
    )
    stopped = F.struct(
        F.lit("block").alias("action"),
        F.lit(None).cast("string").alias("text"),
        F.lit(fixed.UNVERIFIED_REASON).alias("reason"),
    )
    return F.when(F.coalesce(ok, F.lit(False)), sent).otherwise(stopped)


def surface_modes() -> Column:
    """Modes by surface as a literal map."""
    return F.create_map(
        *[x for s, modes in fixed.SURFACES for x in (F.lit(s), array_of(modes, "string"))]
    )


def modes_for(surface: Column) -> Column:
    return F.coalesce(
        F.element_at(surface_modes(), surface), array_of(fixed.DEFAULT_MODES, "string")
    )
