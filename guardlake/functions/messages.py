"""Request and response bodies: prompts, replies, stream events and format translation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed import traffic as fixed
from guardlake.functions import payload
from guardlake.functions.expr import drop_matches, found, js_trim, let
from guardlake.functions.routing import resolve_model

CHAT = "array<struct<role:string,content:string>>"


def strip_boilerplate(text: Column) -> Column:
    """Remove the wrappers that clients put around what the user typed."""
    for pattern in fixed.BOILERPLATE_TAGS:
        text = drop_matches(text, pattern, "i")
    return js_trim(text)


def _text_of(block: Column) -> Column:
    return F.coalesce(payload.string_field(block, "$.text"), F.lit(""))


def block_text(content: Column) -> Column:
    """Message content (a variant) as text: a string, or the joined texts of its blocks."""
    joined = F.array_join(F.transform(payload.list_field(content), _text_of), "")
    return F.coalesce(payload.string_field(content), joined, F.lit(""))


def user_prompt(body: Column) -> Column:
    """The last user message that still has text once its wrappers are gone."""

    def last(v: Column) -> Column:
        def mine(m: Column) -> Column:
            return payload.string_field(m, "$.role") == "user"

        users = F.filter(payload.list_field(v, "$.messages"), mine)
        texts = F.transform(users, lambda m: strip_boilerplate(block_text(payload.field(m, "$.content"))))
        spoken = F.filter(texts, lambda t: t != "")
        prompt = F.coalesce(F.try_element_at(spoken, F.lit(-1)), F.lit(fixed.NO_USER_TEXT))
        return F.when(v.isNull(), fixed.BAD_REQUEST_SNAPSHOT).otherwise(prompt)

    blank = js_trim(F.coalesce(body, F.lit(""))) == ""
    return F.when(blank, fixed.NO_SNAPSHOT).otherwise(let(payload.parsed(body), last))


def visible_delta(provider: Column, event: Column) -> Column:
    """Text a stream event adds to the visible reply, null if none."""
    block = (provider == "anthropic") & (
        payload.string_field(event, "$.type") == "content_block_delta"
    )
    return (
        F.when(block, payload.string_field(event, "$.delta.text"))
        .when(provider == "openai", payload.string_field(event, "$.choices[0].delta.content"))
        .when(
            provider == "gemini",
            payload.string_field(event, "$.candidates[0].content.parts[0].text"),
        )
    )


def is_event_stream(body: Column) -> Column:
    return found(body, r"(^|\n)\s*(event:|data:)")


def assistant_output(provider: Column, body: Column) -> Column:
    """Reply text of a response body, streamed or not, or a note on why there is none."""

    def streamed(s: Column) -> Column:
        data = F.filter(F.split(s, r"\r?\n", -1), lambda line: F.startswith(line, F.lit("data:")))
        deltas = F.transform(
            data,
            lambda line: let(
                payload.parsed(js_trim(F.substring(line, F.lit(6), F.length(line)))),
                lambda e: visible_delta(provider, e),
            ),
        )
        text = F.array_join(F.filter(deltas, lambda d: d.isNotNull()), "")
        return F.when(text == "", fixed.NO_STREAM_TEXT).otherwise(text)

    def buffered(v: Column) -> Column:
        blocks = F.array_join(F.transform(payload.list_field(v, "$.content"), _text_of), "")
        anthropic = F.when(blocks == "", fixed.NO_CONTENT_TEXT).otherwise(blocks)
        openai = F.coalesce(
            payload.string_field(v, "$.choices[0].message.content"),
            payload.string_field(v, "$.choices[0].text"),
        )
        gemini = payload.string_field(v, "$.candidates[0].content.parts[0].text")
        text = (
            F.when(provider == "anthropic", anthropic)
            .when(provider == "openai", openai)
            .when(provider == "gemini", gemini)
        )
        known = F.coalesce(text, F.lit(fixed.NO_ASSISTANT_TEXT))
        return F.when(v.isNull(), fixed.BAD_RESPONSE_SNAPSHOT).otherwise(known)

    def read(s: Column) -> Column:
        return (
            F.when(s == "", fixed.EMPTY_RESPONSE)
            .when(is_event_stream(s), let(s, streamed))
            .otherwise(let(payload.parsed(s), buffered))
        )

    return let(js_trim(F.coalesce(body, F.lit(""))), read)


def _is_empty_text(block: Column) -> Column:
    text = js_trim(F.coalesce(payload.string_field(block, "$.text"), F.lit("")))
    is_text = payload.string_field(block, "$.type") == "text"
    return F.coalesce(is_text & (text == ""), F.lit(False))


def _kept_blocks(items: Column) -> Column:
    """JSON text of a block list without its empty texts, null when nothing was dropped."""
    kept = F.filter(items, lambda b: ~_is_empty_text(b))
    return let(
        kept,
        lambda k: F.when(
            F.size(k) < F.size(items),
            F.when(F.size(k) == 0, '[{"type":"text","text":" "}]').otherwise(
                payload.list_text(F.transform(k, lambda b: F.to_json(b)))
            ),
        ),
    )


def drop_empty_blocks(body: Column) -> Column:
    """Remove empty text blocks from ``messages`` and ``system``; one blank stays if all were empty."""

    def fix_message(m: Column) -> Column:
        blocks = payload.list_field(m, "$.content")
        fixed_blocks = F.when(blocks.isNotNull(), let(blocks, _kept_blocks))
        raw = F.to_json(m)
        return let(
            fixed_blocks,
            lambda f: F.when(f.isNull(), raw).otherwise(
                payload.object_text(payload.with_member(payload.members(raw), "content", f))
            ),
        )

    def fix(v: Column) -> Column:
        messages = payload.list_field(v, "$.messages")
        system = payload.list_field(v, "$.system")
        entries = payload.members(body)
        new_messages = payload.list_text(F.transform(messages, fix_message))
        with_messages = F.when(
            messages.isNotNull(), payload.with_member(entries, "messages", new_messages)
        ).otherwise(entries)
        new_system = F.when(system.isNotNull(), let(system, _kept_blocks))
        return let(
            with_messages,
            lambda m: payload.object_text(
                F.when(new_system.isNotNull(), payload.with_member(m, "system", new_system)).otherwise(m)
            ),
        )

    # Only bodies that hold an empty text block are taken apart.
    may_hold = F.contains(body, F.lit('"type"')) & F.contains(body, F.lit('"text"'))
    return let(
        F.when(may_hold, payload.parsed(body)),
        lambda v: F.when(payload.is_object(v), fix(v)).otherwise(body),
    )


def to_anthropic_request(
    body: Column, aliases: dict[str, str], default_model: str, max_tokens: int
) -> Column:
    """Chat-completions body as a messages-API body; null where ``messages`` is missing or empty."""

    def content_text(content: Column) -> Column:
        def part(p: Column) -> Column:
            return F.coalesce(payload.string_field(p), _text_of(p))

        joined = F.array_join(F.transform(payload.list_field(content), part), "")
        return F.coalesce(payload.string_field(content), joined, F.lit(""))

    def chat(role: str, text) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    def convert(v: Column) -> Column:
        given = F.filter(payload.list_field(v, "$.messages"), lambda m: payload.is_object(m))
        messages = F.transform(
            given,
            lambda m: F.struct(
                F.coalesce(payload.field(m, "$.role", "string"), F.lit("user")).alias("role"),
                content_text(payload.field(m, "$.content")).alias("content"),
            ),
        )

        def build(items: Column) -> Column:
            system = F.filter(items, lambda m: (m["role"] == "system") & (m["content"] != ""))
            turns = F.transform(
                F.filter(items, lambda m: m["role"] != "system"),
                lambda m: F.when(m["role"] == "assistant", chat("assistant", m["content"])).otherwise(
                    chat("user", m["content"])
                ),
            )
            blank = F.array(chat("user", F.lit(" ")))
            led = let(
                turns,
                lambda t: F.when(
                    (F.size(t) == 0) | (F.get(t, F.lit(0))["role"] != "user"), F.concat(blank, t)
                ).otherwise(t),
            )
            asked = payload.number_field(v, "$.max_tokens").cast("bigint")
            streams = payload.kind_of(v, "$.stream") == "BOOLEAN"
            return F.struct(
                resolve_model(
                    F.coalesce(payload.string_field(v, "$.model"), F.lit("")), aliases, default_model
                ).alias("model"),
                F.when(asked > 0, asked).otherwise(max_tokens).cast("bigint").alias("max_tokens"),
                led.alias("messages"),
                F.when(
                    F.size(system) > 0,
                    F.array_join(F.transform(system, lambda m: m["content"]), "\n\n"),
                ).alias("system"),
                payload.number_field(v, "$.temperature").alias("temperature"),
                payload.number_field(v, "$.top_p").alias("top_p"),
                F.when(streams & payload.field(v, "$.stream", "boolean"), True).alias("stream"),
            )

        listed = F.size(payload.list_field(v, "$.messages")) > 0
        return F.when(listed, let(messages, build))

    return let(payload.parsed(body), convert)


def stop_reason(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.STOP_REASONS.items() for x in kv])
    return F.coalesce(F.element_at(table, reason), F.lit("stop"))


def to_openai_response(body: Column, model: Column, now: Column, fallback_id: str) -> Column:
    """Messages-API response as a chat completion struct."""

    def convert(v: Column) -> Column:
        texts = F.transform(
            F.filter(
                payload.list_field(v, "$.content"), lambda b: payload.string_field(b, "$.type") == "text"
            ),
            _text_of,
        )
        text = F.coalesce(F.array_join(texts, ""), F.lit(""))
        zero = F.lit(0).cast("bigint")
        asked = F.coalesce(payload.number_field(v, "$.usage.input_tokens").cast("bigint"), zero)
        told = F.coalesce(payload.number_field(v, "$.usage.output_tokens").cast("bigint"), zero)
        return F.struct(
            F.coalesce(payload.string_field(v, "$.id"), F.lit(fallback_id)).alias("id"),
            F.lit("chat.completion").alias("object"),
            now.cast("bigint").alias("created"),
            model.alias("model"),
            F.array(
                F.struct(
                    F.lit(0).alias("index"),
                    F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"),
                    stop_reason(payload.string_field(v, "$.stop_reason")).alias("finish_reason"),
                )
            ).alias("choices"),
            F.struct(
                asked.alias("prompt_tokens"),
                told.alias("completion_tokens"),
                (asked + told).alias("total_tokens"),
            ).alias("usage"),
        )

    return let(payload.parsed(body), convert)
