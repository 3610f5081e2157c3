"""WARC derivatives: a plain-text conversion record and a metadata record for every response. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions.expr import let

EOL, END = "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# Elements without text of their own, and elements that begin a new line.
SILENT = ["script", "style", "noscript", "template"]
# The common "<" stands in front, so that most characters are passed over at once.
SILENT_ELEMENT = "(?is)<(?:" + "|".join(rf"{name}\b[^>]*>.*?(?:</{name}\s*>|\z)" for name in SILENT) + ")"
# The address of a link, with its quotation marks if it has any.
LINK = r"""(?i)<a\b[^>]*?[ \t\r\n\f/]href[ \t\r\n\f]*=[ \t\r\n\f]*("[^"]*"|'[^']*'|[^ \t\r\n\f"'>][^ \t\r\n\f>]*)"""
BREAKING = (
    # By first letters, so that a tag is tried with few names.
    "p(?:re)?|d(?:iv|[ltd])|b(?:r|lockquote)|li|ul|ol|h(?:[1-6r]|eader)|t(?:[rdh]|able|itle)|a(?:rticle|side)|section|nav|"
    "f(?:ooter|orm|ig(?:ure|caption))|main"
)
# Named character references; "amp" comes last, so that nothing is read twice.
NAMED = [
    ("nbsp", " "),
    ("lt", "<"),
    ("gt", ">"),
    ("quot", '"'),
    ("apos", "'"),
    ("copy", "©"),
    ("reg", "®"),
    ("trade", "™"),
    ("middot", "·"),
    ("bull", "•"),
    ("hellip", "…"),
    ("ndash", "–"),
    ("mdash", "—"),
    ("laquo", "«"),
    ("raquo", "»"),
    ("euro", "€"),
    ("amp", "&"),
]


ADDED = {"record_type", "record_id", "refers_to", "target_uri", "block", "block_digest", "derived"}


def sealed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once, however often they are used."""
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("sealed")
    return df.select("*", held).select(*df.columns, "sealed.*")


def digest(data: Column) -> Column:
    """``sha1:`` and the digest in base 32, as crawlers write it."""

    def written(raw: Column) -> Column:
        # Ten hexadecimal digits are eight of base 32, which Spark writes as 0 to V.
        places = [F.lpad(F.conv(F.substring(raw, start, 10), 16, 32), 8, "0") for start in (1, 11, 21, 31)]
        return F.concat(F.lit("sha1:"), F.translate(F.concat(*places), DIGITS32, BASE32))

    return let(F.sha1(data), written)


def uuid_of(name: Column) -> Column:
    """A record id made of a name, the same in every run."""

    def written(h: Column) -> Column:
        parts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    return let(F.sha1(name.cast("binary")), written)


def lines(*pairs: tuple[str, Column]) -> Column:
    """``Name: value`` lines; those with a null or empty value are left out."""
    return F.concat(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{n}: "), v, F.lit(EOL))).otherwise("") for n, v in pairs])


def record(header: Column, block: Column) -> Column:
    """A whole record: version line, header lines, block and the two line ends behind it."""
    head = F.concat(F.lit("WARC/1.1" + EOL), header, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(head.cast("binary"), block, F.lit(END).cast("binary"))


def field(head: Column, name: str) -> Column:
    """The value of a header line, whatever the case of its name; empty if there is none."""
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)


def responses(pages: DataFrame, url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Add ``record``: each page as a WARC response record, with block and payload digests. Null pages are empty."""
    target = F.coalesce(F.col(url), F.lit(""))
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    df = pages.select(F.struct(*pages.columns).alias("page"), target.alias("target"), payload.alias("payload"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(END),
    )
    df = sealed(df, block=F.concat(http.cast("binary"), F.col("payload")))
    df = sealed(
        df,
        id=uuid_of(F.concat("target", F.lit("#"), F.sha1("payload"))),
        payload_digest=digest(F.col("payload")),
        block_digest=digest(F.col("block")),
    )
    header = lines(
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", F.col("id")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("target")),
        ("WARC-Payload-Digest", F.col("payload_digest")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    )
    kept = [F.col(f"page.`{c}`").alias(c) for c in pages.columns if c.lower() != "record"]
    return df.select(*kept, record(header, F.col("block")).alias("record"))


def _numbered(text: Column) -> Column:
    """Decimal and hexadecimal character references replaced; numbers that are no character become U+FFFD, U+FEFF goes."""
    def put(piece: Column) -> Column:
        return let(F.regexp_extract(piece, "^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});", 1), lambda shown: replaced(piece, shown))

    def replaced(piece: Column, shown: Column) -> Column:
        hexed = F.lower(F.substring(shown, 1, 1)) == "x"
        code = F.when(hexed, F.conv(F.substring(shown, 2, 8), 16, 10)).otherwise(shown).cast("int")
        bad = (code < 1) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(code).cast("long")), 8, "0")), "UTF-32")
        plain = F.concat(F.lit("&#"), piece)
        return F.when(shown == "", plain).otherwise(F.concat(char, F.substring(piece, F.length(shown) + 2, F.length(piece))))

    def joined(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(put(x))), "")

    return F.when(F.contains(text, F.lit("&#")), let(F.split(text, "&#"), joined)).otherwise(text)


def _named(text: Column) -> Column:
    """Named character references replaced, those of ``NAMED``."""
    out = text
    for name, char in NAMED:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def resolved(text: Column) -> Column:
    """Character references replaced, by number or name."""
    return let(_numbered(text), _named)


def plain_text(html: Column) -> Column:
    """The text of a page: comments, scripts and styles out, block elements on lines of their own, references
    resolved, white space tidied."""
    text = F.when(F.contains(html, F.lit("<!--")), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(html)
    text = F.regexp_replace(text, SILENT_ELEMENT, " ")
    # Single spaces, which are most of the white space, need no rewriting.
    space = r"\r\n\t\f\x0B "
    text = F.regexp_replace(text, rf"[{space}](?:(?<! )|(?=[{space}]))[{space}]*", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKING})\b[^>]*>", "\n")
    text = let(F.regexp_replace(text, r"<[/!?a-zA-Z][^>]*>", ""), resolved)
    space = r"\r\t\f\x0B \x{A0}"
    text = F.regexp_replace(text, rf"[{space}](?:(?<! )|(?=[{space}]))[{space}]*", " ")
    # Outer blanks of lines go, and so do blank lines.
    shown = F.filter(F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" "))), lambda line: line != "")
    return F.array_join(shown, "\n")


def outlinks(html: Column) -> Column:
    """Addresses of all links, in any quotation; references are resolved, tabs and line ends go, outer blanks too."""

    def address(u: Column) -> Column:
        inner = F.when(F.substring(u, 1, 1).isin('"', "'"), F.substring(u, F.lit(2), F.length(u) - 2)).otherwise(u)
        return F.btrim(F.translate(resolved(inner), "\t\r\n", ""))

    return F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), address)


def derive(records: DataFrame, column: str = "record") -> DataFrame:
    """Two rows for every WARC response record: a ``conversion`` to plain text and a ``metadata`` record.

    Added columns: record_type, record_id, refers_to, target_uri, block, block_digest and the whole ``derived`` record
    in bytes. The others stay, but for ``column`` and such with the name of an added one. Both records refer to the response by id, address and date.
    The conversion carries the response's payload digest on as its source; the metadata block repeats the source's
    record headers and HTTP headers, tells if its digests hold, and names the conversion, the title and all links.

    Rows whose record is null, or is not a response, give nothing. A record without HTTP headers has an empty
    payload; one without an id refers to nothing. Repeated records give repeated rows. Text in UTF-8 has malformed
    bytes replaced; ISO-8859-1 and windows-1252 are read as ISO-8859-1, all else as UTF-8.
    """
    others = [c for c in records.columns if c.lower() not in {column.lower(), *ADDED}]
    df = records.select(F.struct(*others).alias("other") if others else F.struct(F.lit(1)).alias("other"), F.col(column).alias("raw"))
    df = sealed(df, head=F.substring_index(F.col("raw").cast("string"), END, 1)).where(field(F.col("head"), "WARC-Type") == "response")
    size = F.coalesce(F.try_to_number(field(F.col("head"), "Content-Length"), F.lit("9999999999")).cast("int"), F.octet_length("raw"))
    df = sealed(
        df,
        block=F.substring(F.col("raw"), F.octet_length("head") + 5, size),
        id=field(F.col("head"), "WARC-Record-ID"),
        uri=field(F.col("head"), "WARC-Target-URI"),
        date=field(F.col("head"), "WARC-Date"),
        payload_digest=field(F.col("head"), "WARC-Payload-Digest"),
        source_digest=field(F.col("head"), "WARC-Block-Digest"),
    ).drop("raw")
    df = sealed(df, http=F.substring_index(F.col("block").cast("string"), END, 1))
    df = sealed(
        df,
        payload=F.substring(F.col("block"), F.octet_length("http") + 5, F.octet_length("block")),
        charset=F.regexp_extract(F.lower(field(F.col("http"), "Content-Type")), 'charset="?([^\\s;"]+)', 1),
    )
    latin = F.col("charset").isin("iso-8859-1", "latin1", "windows-1252")
    html = F.when(latin, F.decode("payload", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("payload").cast("string")))
    df = sealed(
        df,
        html=html,
        payload_holds=F.when(F.col("payload_digest") != "", (digest(F.col("payload")) == F.col("payload_digest")).cast("string")),
        block_holds=F.when(F.col("source_digest") != "", (digest(F.col("block")) == F.col("source_digest")).cast("string")),
    ).drop("payload", "block")
    df = sealed(df, text=plain_text(F.col("html")), title=plain_text(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title", 1)))
    df = sealed(
        df,
        conversion_id=uuid_of(F.concat("id", F.lit("#conversion"))),
        metadata_id=uuid_of(F.concat("id", F.lit("#metadata"))),
        links=F.array_join(F.transform(outlinks(F.col("html")), lambda u: F.concat(F.lit("outlink: "), u, F.lit(EOL))), ""),
    )
    conversion_id, metadata_id, links = F.col("conversion_id"), F.col("metadata_id"), F.col("links")
    headers = F.regexp_replace(F.regexp_replace("http", r"\r?\n", EOL), "(?m)^([^\r\n]+)(?=\r?$)", "http-header: $1")
    about = F.concat(
        lines(
            ("source-record-id", F.col("id")),
            ("source-payload-digest", F.col("payload_digest")),
            ("source-payload-digest-holds", F.col("payload_holds")),
            ("source-block-digest", F.col("source_digest")),
            ("source-block-digest-holds", F.col("block_holds")),
            ("source-content-type", field(F.col("head"), "Content-Type")),
            ("source-content-length", field(F.col("head"), "Content-Length")),
            ("conversion-record-id", conversion_id),
            ("title", F.col("title")),
        ),
        F.when(F.col("http") != "", F.concat(headers, F.lit(EOL))).otherwise(""),
        links,
    )
    made = F.array(
        F.struct(F.lit("conversion").alias("record_type"), conversion_id.alias("record_id"), F.lit("text/plain; charset=UTF-8").alias("kind"), F.col("text").alias("body")),
        F.struct(F.lit("metadata").alias("record_type"), metadata_id.alias("record_id"), F.lit("application/warc-fields").alias("kind"), about.alias("body")),
    )
    out = df.select("other", "id", "uri", "date", "payload_digest", F.explode(made).alias("made")).select("*", "made.*")
    out = sealed(out, block_digest=digest(F.col("body").cast("binary")))
    header = lines(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Refers-To", F.col("id")),
        ("WARC-Refers-To-Target-URI", F.col("uri")),
        ("WARC-Refers-To-Date", F.col("date")),
        ("WARC-Source-Payload-Digest", F.col("payload_digest")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("kind")),
    )
    return out.select(
        *([F.col(f"other.`{c}`").alias(c) for c in others]),
        "record_type",
        "record_id",
        F.col("id").alias("refers_to"),
        F.col("uri").alias("target_uri"),
        F.col("body").alias("block"),
        "block_digest",
        record(header, F.col("body").cast("binary")).alias("derived"),
    )
