"""Prompt risk: cheap shape tests, known signatures, verdicts and guidance texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed import prompts as fixed
from guardlake.functions import payload
from guardlake.functions.expr import any_of, array_of, found, js_trim, let
from guardlake.functions.regex import ANY_SPACE

VERDICT = "struct<risk:boolean,categories:array<string>,confidence:double>"


def looks_like_code_or_data(prompt: Column) -> Column:
    return any_of(found(prompt, p, f) for p, f in fixed.CODE_OR_DATA_SHAPES)


def has_action_verb(prompt: Column) -> Column:
    return found(prompt, fixed.ACTION_WORDS, "i")


def is_factual_question(prompt: Column) -> Column:
    return found(prompt, fixed.FACTUAL_SHAPE, "i")


def is_trivial(prompt: Column) -> Column:
    """A short, purely informational question, or nothing at all."""

    def check(p: Column) -> Column:
        short = F.length(p) <= fixed.TRIVIAL_MAX_CHARS
        few = F.size(F.split(p, f"[{ANY_SPACE}]+", -1)) <= fixed.TRIVIAL_MAX_WORDS
        plain = ~looks_like_code_or_data(p) & ~has_action_verb(p) & is_factual_question(p)
        return (p == "") | (short & few & plain)

    return let(js_trim(F.coalesce(prompt, F.lit(""))), check)


def known_injection(prompt: Column) -> Column:
    """Categories of the first matching signature, null when none matches."""
    result = F.lit(None).cast("array<string>")
    for pattern, categories in reversed(fixed.INJECTION_SIGNATURES):
        result = F.when(found(prompt, pattern, "i"), array_of(categories, "string")).otherwise(result)
    return result


def valid_categories(categories: Column) -> Column:
    """Known labels only; order and repeats are kept."""
    kept = F.filter(categories, lambda c: c.isin(list(fixed.GUIDANCE)))
    return F.coalesce(kept, array_of([], "string"))


def has_block(categories: Column) -> Column:
    blocking = [c for c, (action, _) in fixed.GUIDANCE.items() if action == "block"]
    return F.coalesce(F.arrays_overlap(categories, array_of(blocking, "string")), F.lit(False))


def template_ids(categories: Column) -> Column:
    return F.array_distinct(valid_categories(categories))


def build_guidance(categories: Column) -> Column:
    """Prefix, introduction and one bullet per distinct known category; '' if there is none."""
    texts = F.create_map(*[F.lit(x) for c, (_, text) in fixed.GUIDANCE.items() for x in (c, text)])

    def build(ids: Column) -> Column:
        bullets = F.transform(ids, lambda c: F.concat(F.lit("- "), F.element_at(texts, c)))
        head = F.lit(f"{fixed.GUIDANCE_PREFIX}\n{fixed.GUIDANCE_INTRO}\n")
        block = F.concat(head, F.array_join(bullets, "\n"))
        return F.when(F.size(ids) == 0, "").otherwise(block)

    return let(template_ids(categories), build)


def json_candidate(reply: Column) -> Column:
    """The JSON object inside a model reply: code fences and surrounding prose removed."""
    opened = F.regexp_replace(js_trim(reply), r"(?i)^```(?:json)?\s*", "")
    bare = js_trim(F.regexp_replace(opened, r"\s*```\z", ""))
    return let(
        bare,
        lambda t: F.when(F.startswith(t, F.lit("{")), t).otherwise(
            F.when(t.rlike(r"\{[\s\S]*\}"), F.regexp_extract(t, r"\{[\s\S]*\}", 0))
        ),
    )


def parse_verdict(reply: Column) -> Column:
    """Verdict from a classifier's reply; null when nothing usable is found."""

    def read(v: Column) -> Column:
        labels = F.filter(
            F.transform(payload.list_field(v, "$.categories"), lambda c: payload.string_field(c)),
            lambda c: c.isNotNull(),
        )
        risk = payload.kind_of(v, "$.risk") == "BOOLEAN"
        risk = risk & payload.field(v, "$.risk", "boolean")
        return F.when(
            v.isNotNull(),
            F.struct(
                F.coalesce(risk, F.lit(False)).alias("risk"),
                valid_categories(labels).alias("categories"),
                F.coalesce(payload.number_field(v, "$.confidence"), F.lit(0.0)).alias("confidence"),
            ),
        )

    return let(payload.parsed(json_candidate(reply)), read)


def analysis(prompt: Column, verdict: Column | None = None) -> Column:
    """``struct<verdict, categories, confidence, tier>`` for one prompt.

    ``verdict`` is the second tier's answer; pass none to switch that tier off. Whatever is missing or
    unusable there ends in allow: this guard fails open.
    """
    none = array_of([], "string")

    def answer(name, categories: Column, confidence: Column, tier: int) -> Column:
        return F.struct(
            (name if isinstance(name, Column) else F.lit(name)).alias("verdict"),
            categories.alias("categories"),
            confidence.cast("double").alias("confidence"),
            F.lit(tier).alias("tier"),
        )

    def action(categories: Column) -> Column:
        return F.when(has_block(categories), "block").otherwise("inject")

    def allow(tier: int) -> Column:
        return answer("allow", none, F.lit(0.0), tier)

    if verdict is None:
        second = allow(1)
    else:
        labels = valid_categories(verdict["categories"])
        risky = F.coalesce(verdict["risk"], F.lit(False)) & (F.size(labels) > 0)
        confidence = F.coalesce(verdict["confidence"], F.lit(0.0))
        second = (
            F.when(verdict.isNull(), allow(2))
            .when(risky, answer(action(labels), labels, confidence, 2))
            .otherwise(answer("allow", none, confidence, 2))
        )
    known = let(
        known_injection(prompt),
        lambda k: F.when(k.isNotNull(), answer(action(k), k, F.lit(fixed.KNOWN_CONFIDENCE), 1)),
    )
    return F.when(is_trivial(prompt), allow(1)).otherwise(F.coalesce(known, second))


def inject_guidance(body: Column, provider: Column, guidance: Column) -> Column:
    """Append the guidance to the system channel of a request body; anything unfit is left unchanged."""
    quoted = payload.json_text(guidance)
    block = F.concat(F.lit('{"type":"text","text":'), quoted, F.lit("}"))
    part = F.concat(F.lit('{"text":'), quoted, F.lit("}"))

    def joined(old: Column) -> Column:
        text = F.get(F.from_json(F.concat(F.lit("["), old, F.lit("]")), "array<string>"), F.lit(0))
        return payload.json_text(F.concat(text, F.lit("\n\n"), guidance))

    def appended(old: Column, item: Column) -> Column:
        inner = F.regexp_replace(old, r"\]\s*\z", "")
        comma = F.when(inner.rlike(r"^\s*\[\s*\z"), "").otherwise(",")
        return F.concat(inner, comma, item, F.lit("]"))

    def anthropic(m: Column) -> Column:
        old = m["system"]
        new = (
            F.when(F.startswith(old, F.lit("[")), appended(old, block))
            .when(F.startswith(old, F.lit('"')), joined(old))
            .otherwise(F.concat(F.lit("["), block, F.lit("]")))
        )
        return payload.with_member(m, "system", new)

    def gemini(m: Column) -> Column:
        def known(key: str) -> Column:
            return F.when(m[key] != "null", m[key])

        old = F.coalesce(known("systemInstruction"), known("system_instruction"), F.lit("{}"))

        def edit(inner: Column) -> Column:
            parts = inner["parts"]
            listed = F.startswith(parts, F.lit("["))
            new = F.when(listed, appended(parts, part)).otherwise(
                F.concat(F.lit("["), part, F.lit("]"))
            )
            return payload.object_text(payload.with_member(inner, "parts", new))

        empty = F.create_map().cast("map<string,string>")
        system = let(F.coalesce(payload.members(old), empty), edit)
        return payload.without_member(
            payload.with_member(m, "systemInstruction", system), "system_instruction"
        )

    def openai(m: Column) -> Column:
        listed = F.coalesce(F.from_json(m["messages"], "array<variant>"), F.array().cast("array<variant>"))

        def edit(messages: Column) -> Column:
            head = payload.members(F.to_json(F.get(messages, F.lit(0))))
            texts = F.transform(messages, lambda x: F.to_json(x))
            system = F.concat(F.lit('{"role":"system","content":'), quoted, F.lit("}"))
            merged = let(
                head,
                lambda h: F.when(
                    (h["role"] == '"system"') & F.startswith(h["content"], F.lit('"')),
                    payload.object_text(payload.with_member(h, "content", joined(h["content"]))),
                ),
            )
            rest = F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0)))
            return let(
                merged,
                lambda first: F.when(first.isNotNull(), F.concat(F.array(first), rest)).otherwise(
                    F.concat(F.array(system), texts)
                ),
            )

        return payload.with_member(m, "messages", payload.list_text(let(listed, edit)))

    def edit_body(m: Column) -> Column:
        edited = (
            F.when(provider == "anthropic", anthropic(m))
            .when(provider == "gemini", gemini(m))
            .otherwise(openai(m))
        )
        return F.when(m.isNotNull(), payload.object_text(edited))

    usable = (guidance != "") & payload.is_object(payload.parsed(body))
    return F.when(usable, F.coalesce(let(payload.members(body), edit_body), body)).otherwise(body)
