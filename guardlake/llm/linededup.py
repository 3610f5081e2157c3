"""Delete runs of lines that occur earlier, found by winnowing over line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm import common

# White space around and between the words of a line.
BLANK = " \t\x0b\f\r"
WORD = r"[^ \t\x0B\f\r]+"


def _document(docs: DataFrame, key: str) -> Column:
    """What identifies and orders documents: the key, nulls last, then a hash of the row. Maps take no part."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "map"]
    return F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.xxhash64(*plain).alias("r"))


def windows(docs: DataFrame, least_words: int, text: str, key: str) -> DataFrame:
    """One row per line that is not blank, with the window of lines that starts there.

    A window is the shortest run of lines with ``least_words`` words or more. Its fingerprint is its smallest line
    hash, the rightmost of equal ones, at line ``anchor``. ``ahead`` are the line hashes from this line to the end of
    the next line's window, ``behind`` those of earlier lines whose windows reach this line.
    """
    lines = docs.select(_document(docs, key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANK))).where("line <> ''")
    lines = lines.select("doc", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))
    # Rows equal in all columns are one document.
    lines = lines.repartition(common.wide(docs), "doc").dropDuplicates(["doc", "pos"])
    in_order = Window.partitionBy("doc").orderBy("pos")
    by_words = Window.partitionBy("doc").orderBy("before")
    window, reach = by_words.rangeBetween(0, least_words - 1), by_words.rangeBetween(1 - least_words, -1)
    placed = lines.select(
        "doc",
        "h",
        "words",
        (F.row_number().over(in_order) - 1).alias("idx"),
        (F.sum("words").over(in_order) - F.col("words")).alias("before"),
    )
    framed = placed.select(
        "doc",
        "h",
        "idx",
        F.max("idx").over(window).alias("end"),
        F.collect_list("h").over(window).alias("members"),
        F.sum("words").over(window).alias("total"),
        F.min(F.struct("h", (-F.col("idx")).alias("back"))).over(window).alias("low"),
        F.collect_list("h").over(reach).alias("behind"),
    )
    following = Window.partitionBy("doc").orderBy("idx")
    return framed.select(
        "doc",
        "idx",
        (F.col("total") >= least_words).alias("full"),
        F.col("low.h").alias("print"),
        (-F.col("low.back")).alias("anchor"),
        # With the fingerprint this makes 160 bits that tell windows apart.
        F.xxhash64("members").alias("digest"),
        F.hash("members").alias("check"),
        F.coalesce(F.lead("end").over(following), F.col("end")).alias("next_end"),
        F.size("members").alias("size"),
        F.coalesce(F.lead("total").over(following) >= least_words, F.lit(False)).alias("next_full"),
        F.concat(F.array("h"), F.coalesce(F.lead("members").over(following), F.array().cast("array<bigint>"))).alias("ahead"),
        "behind",
    )


def _common_prefix(a: Column, b: Column) -> Column:
    """How many leading items of two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def repeated_runs(docs: DataFrame, least_words: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, runs): per document the runs of lines to delete, as sorted pairs of numbers among its lines that are
    not blank.

    Windows with equal fingerprint and content are joined to the first of them, in the order of documents and lines.
    So are windows grown line by line up to where the next line's window ends, as a grown one may have come earlier at
    another place than the window itself; one that has grown further holds the next window, which speaks for itself.
    Windows of a document with one anchor and one partner are one match. A match is extended from its anchor backwards
    and forwards while lines agree, forwards at most to the end of the window after its last one. So every run of
    ``least_words`` words or more that occurs earlier anywhere is found whole, whatever surrounds it, and a passage in
    very many documents costs few rows each: every form of it is paired with its first place only.
    """
    found = common.written(windows(docs, least_words, text, key), "windows", compression="zstd")
    content = ["print", "digest", "check"]

    def firsts(forms: DataFrame) -> DataFrame:
        first = forms.groupBy(*content).agg(F.count("*").alias("n"), F.min(F.struct("doc", "idx")).alias("first"))
        return forms.join(first.where("n > 1").drop("n"), content)

    plain = firsts(found.where("full").select("doc", "idx", "anchor", "next_end", *content))
    grows = found.where("full").withColumn("most", F.size("ahead") - F.col("next_full").cast("int")).where("most > size")
    # Only repeated windows have repeated forms.
    some = plain.select("doc", "idx").join(grows.select("doc", "idx", "anchor", "next_end", "print", "size", "most", "ahead"), ["doc", "idx"])
    some = some.withColumn("members", F.explode(F.transform(F.sequence(F.col("size") + 1, "most"), lambda k: F.slice("ahead", 1, k))))
    grown = firsts(
        some.select("doc", "idx", "anchor", "next_end", "print", F.xxhash64("members").alias("digest"), F.hash("members").alias("check"))
    )
    matches = (
        plain.unionByName(grown)
        .where(F.struct("doc", "idx") != F.col("first"))
        .groupBy(
            "doc",
            "anchor",
            F.col("first.doc").alias("of_doc"),
            (F.col("first.idx") + F.col("anchor") - F.col("idx")).alias("of_anchor"),
        )
        .agg(F.max("next_end").alias("limit"))
    )

    # Both joins take the windows in one form, so that they move only once.
    def around(name: str) -> DataFrame:
        named = [F.col(c).alias(name + c) for c in ("ahead", "behind")]
        return found.select(F.col("doc").alias("d"), F.col("idx").alias("i"), *named)

    own, near = around("own_"), around("near_")
    here = matches.join(own, (matches.doc == own.d) & (matches.anchor == own.i)).drop("d", "i")
    both = here.join(near, (here.of_doc == near.d) & (here.of_anchor == near.i)).drop("d", "i")
    spans = both.select(
        "doc",
        (F.col("anchor") - _common_prefix(F.reverse("own_behind"), F.reverse("near_behind"))).alias("start"),
        F.least("limit", F.col("anchor") + _common_prefix(F.col("own_ahead"), F.col("near_ahead")) - 1).alias("stop"),
    )
    gone = spans.select("doc", F.explode(F.sequence("start", "stop")).alias("idx")).distinct()
    island = F.col("idx") - F.row_number().over(Window.partitionBy("doc").orderBy("idx"))
    runs = gone.select("doc", "idx", island.alias("island")).groupBy("doc", "island")
    runs = runs.agg(F.min("idx").alias("start"), F.max("idx").alias("stop"))
    return runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def deduplicate(docs: DataFrame, least_words: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Delete from each text the runs of lines, with ``least_words`` words or more, that occur earlier.

    Earlier is a smaller key (nulls last), then a smaller line number, so every line stays at its first place. Lines
    are compared without white space around them; blank lines take no part and go only with a run around them.
    Columns are as given; a null text stays null, and a text of repeated lines only becomes empty. Rows equal in key
    and all columns are one document and share its fate.
    """
    runs = repeated_runs(docs, least_words, text, key)
    at, spans, lines, full = (common.fresh(docs, c) for c in ("at", "runs", "lines", "full"))
    joined = docs.withColumn(at, _document(docs, key)).join(runs.select(F.col("doc").alias(at), F.col("runs").alias(spans)), at, "left")
    split = joined.withColumn(lines, F.when(F.col(spans).isNotNull(), F.split(text, "\n")))
    numbered = split.withColumn(
        full,
        F.filter(
            F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) != "", i)),
            lambda i: i.isNotNull(),
        ),
    )
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda r: F.get(full, r["stop"]) + 1))
    stops = F.concat(F.transform(spans, lambda r: F.get(full, r["start"])), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(F.col(lines), a + 1, b - a)))
    rebuilt = F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return numbered.withColumn(text, rebuilt).select(*docs.columns)
