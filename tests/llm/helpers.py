"""Small frames with awkward rows, and plain versions of operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, block int, n long, fp string"


def prose(seed: int, words: int = 120, per_line: int = 12) -> str:
    rng = random.Random(seed)
    out = ["".join(rng.choice(["ba", "ko", "ti", "ré", "su", "Na", "mel"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + per_line]) for i in range(0, words, per_line))


def texts() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, repeated rows and ids, a long text."""
    a, b, c = prose(1), prose(2), prose(3, 400)
    near = a.replace(a.split()[60], "changed", 1)
    long = "\n".join(prose(i, 300) for i in range(10, 40))
    rows = [(1, a), (2, a), (3, near), (4, b), (5, c + "\n" + b), (6, ""), (7, None), (8, " \n\t "), (9, "one"), (10, "ONE two")]
    rows += [(11, long), (12, a + "\n\n" + c), (13, "x"), (13, "x"), (14, b), (14, prose(4)), (None, "no id"), (None, a)]
    return rows + [(15, "idiot " + prose(5)), (16, "tab\x0band\x0cfeed\rreturn"), (17, "日本 語 \U0001f600 é́"), (18, "Same same " * 200)]


def frame(spark, rows=None):
    """Documents with columns that clash with names used inside the operators."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2, "f") for i, t in rows], SCHEMA)


def rows_of(df) -> list:
    return sorted(map(tuple, df.collect()), key=repr)
