"""Transcript messages: typed text, attachments, mentions, page chrome and reply scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed import turns as fixed
from guardlake.functions import payload
from guardlake.functions.expr import all_matches, drop_matches, found, js_trim, let
from guardlake.functions.regex import ANY_SPACE


def message_text(content: Column) -> Column:
    """Message content (a variant): a string, or its text blocks joined."""

    def is_text(b: Column) -> Column:
        return (payload.string_field(b, "$.type") == "text") & payload.string_field(
            b, "$.text"
        ).isNotNull()

    texts = F.transform(
        F.filter(payload.list_field(content), is_text), lambda b: payload.string_field(b, "$.text")
    )
    return F.coalesce(payload.string_field(content), F.array_join(texts, ""), F.lit(""))


def _trimmed_parts(parts: Column) -> Column:
    return F.filter(F.transform(parts, js_trim), lambda p: p != "")


def user_queries(text: Column) -> Column:
    """Non-empty, trimmed ``<user_query>`` contents."""
    return _trimmed_parts(all_matches(text, fixed.USER_QUERY, group=1))


def typed_message(text: Column) -> Column:
    """What the user typed: the query blocks, or the text without its context blocks."""
    bare = text
    for pattern in fixed.CONTEXT_TAGS:
        bare = drop_matches(bare, pattern)
    queries = F.array_join(user_queries(text), fixed.TURN_SEPARATOR)
    return F.when(found(text, fixed.USER_QUERY), queries).otherwise(js_trim(bare))


def attachments(text: Column) -> Column:
    parts = _trimmed_parts(all_matches(text, fixed.ATTACHED_FILES, group=1))
    return F.array_join(parts, fixed.TURN_SEPARATOR)


def mention_tokens(prompt: Column) -> Column:
    """``@file`` tokens without trailing punctuation, in order; empty ones dropped."""
    tokens = F.transform(
        all_matches(prompt, fixed.MENTION, group=1),
        lambda t: drop_matches(t, fixed.MENTION_TRAILING),
    )
    return F.filter(tokens, lambda t: t != "")


def looks_like_boilerplate(text: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{ANY_SPACE}]+", " ")
    return found(flat, fixed.PAGE_CHROME, "i")


def looks_like_metadata(text: Column) -> Column:
    """Only sender labels and time stamps, or a short row that carries one."""
    flat = js_trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{ANY_SPACE}]+", " "))

    def check(n: Column) -> Column:
        pieces = _trimmed_parts(F.split(n, "[,\n·|]+", -1))

        def judge(p: Column) -> Column:
            meta = F.size(F.filter(p, lambda x: found(x, fixed.META_PIECE, "i")))
            mostly = meta >= F.ceil(F.size(p) * F.lit(fixed.META_SHORT_SHARE))
            short = (F.length(n) < fixed.META_SHORT_CHARS) & mostly
            row = (F.length(n) < fixed.META_ROW_CHARS) & (meta >= 1)
            return (F.size(p) > 0) & (short | row)

        return let(pieces, judge)

    return let(flat, check)


def reply_score(d: dict[str, Column]) -> Column:
    """Score of one reply candidate; null when it cannot be the reply.

    Keys: text_len, grew, growth_steps, follows_prompt, contains_prompt, interactive,
    interactive_ratio, appeared, visible, metadata_like, boilerplate_like.
    """

    def flag(name: str) -> Column:
        return F.coalesce(d[name], F.lit(False))

    ratio = F.coalesce(d["interactive_ratio"], F.lit(0.0))
    refused = (
        ~flag("visible")
        | ~flag("follows_prompt")
        | flag("contains_prompt")
        | flag("interactive")
        | (ratio > fixed.REPLY_MAX_INTERACTIVE)
        | flag("metadata_like")
        | flag("boilerplate_like")
        | d["text_len"].isNull()
        | (d["text_len"] < fixed.REPLY_MIN_CHARS)
        | (~flag("grew") & ~flag("appeared") & (d["text_len"] < fixed.REPLY_CONFIDENT_CHARS))
    )
    steps = F.coalesce(F.nullif(d["growth_steps"], F.lit(0)), F.lit(1))
    grown = F.when(flag("grew"), 100 + F.least(F.lit(20), steps * 4)).otherwise(0)
    shown = F.when(flag("appeared"), 30).otherwise(0)
    size = F.least(F.lit(60.0), F.log2(d["text_len"].cast("double")) * 6)
    return F.when(~refused, grown + shown + size - ratio * 40)


def strip_reply_label(text: Column) -> Column:
    """Null for a bare label, else the text without a leading label."""
    trimmed = js_trim(text)
    return F.when(
        ~found(trimmed, fixed.REPLY_LABEL_ONLY, "i"),
        js_trim(drop_matches(trimmed, fixed.REPLY_LABEL_PREFIX, "i")),
    )
