"""File names, types and upload decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed import files as fixed
from guardlake.fixed.traffic import UNVERIFIED_REASON
from guardlake.functions.expr import let


def file_extension(name: Column) -> Column:
    """Lower-case extension; a dotfile's name counts as one; '' when there is none."""
    base = F.element_at(F.split(F.coalesce(name, F.lit("")), r"[\\/]", -1), -1)

    def pick(b: Column) -> Column:
        dotfile = F.startswith(b, F.lit(".")) & ~F.contains(
            F.substring(b, F.lit(2), F.length(b)), F.lit(".")
        )
        return (
            F.when(dotfile, F.lower(F.substring(b, F.lit(2), F.length(b))))
            .when(F.contains(b, F.lit(".")), F.lower(F.substring_index(b, ".", -1)))
            .otherwise("")
        )

    return let(base, pick)


def classify_file(
    name: Column, mime: Column, size: Column, text_most: int | None = None, office_most: int | None = None
) -> Column:
    """``struct<scannable, kind, reason>``; a binary extension beats any declared type.

    Files above ``text_most`` or ``office_most`` bytes, if given, are not scannable.
    """

    def above(bytes_: Column, most: int | None) -> Column:
        return F.lit(False) if most is None else bytes_ > most

    def verdict(scannable: bool, kind: str, reason) -> Column:
        return F.struct(
            F.lit(scannable).alias("scannable"),
            F.lit(kind).alias("kind"),
            (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        )

    def judge(f: Column) -> Column:
        ext, kind, bytes_ = f["ext"], f["mime"], f["size"]
        text = (
            ext.isin(fixed.TEXT_EXTENSIONS)
            | F.startswith(kind, F.lit("text/"))
            | kind.isin(fixed.TEXT_MIME_TYPES)
            | F.endswith(kind, F.lit("+json"))
            | F.endswith(kind, F.lit("+xml"))
        )
        office = ext.isin(fixed.OFFICE_EXTENSIONS)
        nameless = (kind == "") & (ext == "")
        unknown = F.when(nameless, "unknown-type").otherwise("unsupported-type")
        return (
            F.when(ext.isin(fixed.BINARY_EXTENSIONS), verdict(False, "none", "binary-extension"))
            .when(office & above(bytes_, office_most), verdict(False, "none", "too-large"))
            .when(office, verdict(True, "ooxml", "ooxml"))
            .when(~text, verdict(False, "none", unknown))
            .when(above(bytes_, text_most), verdict(False, "none", "too-large"))
            .otherwise(verdict(True, "text", "text"))
        )

    clean = F.trim(F.substring_index(F.lower(F.coalesce(mime, F.lit(""))), ";", 1))
    return let(
        F.struct(
            file_extension(name).alias("ext"),
            clean.alias("mime"),
            F.coalesce(size, F.lit(0)).alias("size"),
        ),
        judge,
    )


def decide_upload(
    scannable: Column, reason: Column, text: Column, ok: Column, redacted: Column, pii: Column
) -> Column:
    """``struct<action, reason, detail, text>``: only a verified clean file goes out as it is."""

    def answer(action: str, why: str, detail=None, out=None) -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            F.lit(why).alias("reason"),
            (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
            (F.lit(None).cast("string") if out is None else out).alias("text"),
        )

    verified = F.coalesce(ok, F.lit(False)) & redacted.isNotNull()
    changed = (redacted != text) | F.coalesce(pii, F.lit(False))
    return (
        F.when(
            ~F.coalesce(scannable, F.lit(False)), answer("block", "upload-unscannable", reason)
        )
        .when(text.isNull(), answer("block", "upload-unreadable"))
        .when(~verified, answer("block", UNVERIFIED_REASON))
        .when(changed, answer("replace", "pii-redacted", out=redacted))
        .otherwise(answer("allow", "no-pii"))
    )


def decide_office(readable: Column, has_text: Column, pii: Column) -> Column:
    """``struct<action, reason, detail, text>`` of an office file, which is scanned but not rewritten."""

    def answer(action: str, why: str, detail: str | None = None) -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            F.lit(why).alias("reason"),
            F.lit(detail).cast("string").alias("detail"),
            F.lit(None).cast("string").alias("text"),
        )

    return (
        F.when(~F.coalesce(readable, F.lit(False)), answer("block", "upload-unreadable", fixed.OFFICE_UNREADABLE))
        .when(~has_text, answer("allow", "no-text"))
        .when(F.coalesce(pii, F.lit(False)), answer("block", "pii-not-rewritten"))
        .otherwise(answer("allow", "no-pii"))
    )


def matches_endpoint(url: Column, host: Column, path: Column) -> Column:
    """URL host equals the endpoint host or is below it, and the path holds the endpoint path."""
    url_host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    url_path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    no_host = host.isNull() | (host == "")
    no_path = path.isNull() | (path == "")
    host_ok = no_host | (url_host == host) | F.endswith(url_host, F.concat(F.lit("."), host))
    return F.coalesce(host_ok & (no_path | F.contains(url_path, path)), F.lit(False))


def url_holds(url: Column, fragments: list[str]) -> Column:
    """Plain substring form of the endpoint test."""
    hits = [F.contains(url, F.lit(f)) for f in fragments]
    result = F.lit(False)
    for hit in hits:
        result = result | hit
    return F.coalesce(result, F.lit(False))
