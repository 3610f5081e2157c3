import random

import pytest
from pyspark.sql import functions as F

from guardlake import RuleSet
from guardlake.functions import payload, spans, validators
from guardlake.functions.regex import java_regex
from guardlake.functions.text import redact_url_credentials, residual_pii
from guardlake.operators import redaction
from guardlake.plans import samples
from guardlake.session import spread
from tests.plain_matcher import Matcher


def redact_all(spark, texts, rules=None, direction="inbound"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = redaction.redact(df, "text", rules, direction).orderBy("id").collect()
    return [(r["redacted"], dict(r["matched"])) for r in rows]


CASES = [
    ("num 4929 3187 2064 5307 end", "num 4929 3187 2064 5307 end", {}),
    ("num 4929 3187 2064 5304 end", "num [REDACTED_PII_CREDIT_CARD] end", {"CREDIT_CARD": 1}),
    ("at 127.0.0.1:8000 ok", "at 127.0.0.1:8000 ok", {}),
    ("server 9.18.27.36 seen", "server [REDACTED_PII_IPV4] seen", {"IPV4": 1}),
    (
        "time 12:34:56 count 9876543210 fake 8642 0975 3180 label ABCD1234E",
        "time 12:34:56 count 9876543210 fake 8642 0975 3180 label ABCD1234E",
        {},
    ),
    ("aadhaar 7382 0516 4941", "aadhaar [REDACTED_PII_AADHAAR]", {"AADHAAR": 1}),
    ("curl https://robot:w1nter-gate@api.lan.example/v2", "curl [REDACTED_PII_CONN_STRING]", {"CONN_STRING": 1}),
    ("key sk-proj-Vt4mWq8rLz2xKc6nHb1yJd5pGs9fAe3u", "key [REDACTED_PII_API_KEY]", {"API_KEY": 1}),
    ("not AbCdEfGhIjKl.AbCdEfGhIjKl.AbCdEfGhIjKl", "not AbCdEfGhIjKl.AbCdEfGhIjKl.AbCdEfGhIjKl", {}),
    # Word boundaries are ASCII: an accented letter does not shield a number.
    ("é271-63-8054 x271-63-8054", "é[REDACTED_PII_SSN] x271-63-8054", {"SSN": 1}),
    # Unicode white space separates digit groups.
    ("+91 98765 43210", "[REDACTED_PII_PHONE_IN]", {"PHONE_IN": 1}),
    # The second address begins where the first match ended.
    ("a@b.com_x@y.org", "[REDACTED_PII_EMAIL][REDACTED_PII_EMAIL]", {"EMAIL": 2}),
    ("::1 and ::", "::1 and ::", {}),
    ("", "", {}),
    (None, None, {}),
]


def test_cases(spark):
    got = redact_all(spark, [c[0] for c in CASES])
    assert got == [(c[1], c[2]) for c in CASES]


def test_every_sample_value_is_redacted_and_gone(spark):
    got = redact_all(spark, samples.PII, direction="outbound")
    seen = {rule for _, counts in got for rule in counts}
    assert seen == {r.name for r in RuleSet().rules}
    assert all("REDACTED_PII" not in text for text, _ in got)
    assert "alice:s3cret" not in got[2][0]


def test_same_as_python_model_on_random_text(spark):
    """The Spark expressions and the worker-side matcher are independent; they must agree."""
    rnd = random.Random(7)
    bits = samples.PII + ["1", " ", "-", ".", "@x.org", "é", "4929", "3187", "2064", "5304", "::", "abc", "\n", "+1", "😀"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    matcher = Matcher.of(RuleSet()).compile()
    want = []
    for text in texts:
        counts = {}
        want.append((matcher.redact(text, "inbound", counts), counts))
    assert redact_all(spark, texts) == want


def test_custom_rules_win_ties_and_allowlist_spares(spark):
    rules = RuleSet().add("MAIL2", r"[a-z]+@[a-z]+\.org").add_allow("^keep@")
    got = redact_all(spark, ["x@y.org keep@y.org"], rules)
    assert got == [("[REDACTED_PII_MAIL2] keep@y.org", {"MAIL2": 1})]


def test_rules_that_can_match_nothing(spark):
    rules = RuleSet().only().add("XS", "x*")
    assert redact_all(spark, ["axxbx", "xx", "b", "xb"], rules) == [
        ("a[REDACTED_PII_XS]b[REDACTED_PII_XS]", {"XS": 2}),
        ("[REDACTED_PII_XS]", {"XS": 1}),
        ("b", {}),
        ("[REDACTED_PII_XS]b", {"XS": 1}),
    ]


def test_long_unbroken_run_is_linear(spark):
    text = "a" * 300_000 + " x@y.org"
    assert redact_all(spark, [text]) == [("a" * 300_000 + " [REDACTED_PII_EMAIL]", {"EMAIL": 1})]


def test_many_matches_in_one_text(spark):
    n = 2000
    (text, counts), = redact_all(spark, ["x@y.org 9.18.27.36 " * n])
    assert counts == {"EMAIL": n, "IPV4": n}
    assert text == "[REDACTED_PII_EMAIL] [REDACTED_PII_IPV4] " * n


def test_rule_edits():
    rules = RuleSet()
    with pytest.raises(ValueError):
        rules.remove("EMAIL")
    with pytest.raises(ValueError):
        rules.add("EMAIL", "x")
    custom = rules.add("T", "t+").add("U", "u+")
    assert [r.name for r in custom.rules[:2]] == ["U", "T"]
    assert custom.remove("T").rules[0].name == "U"
    assert "EMAIL" not in [r.name for r in rules.set_enabled("EMAIL", False).active]


def test_rule_files(spark):
    rules = RuleSet().with_rules_json('[{"name": "A", "pattern": "a+", "flags": "gi"}]')
    assert rules.rules[0].java.startswith("(?i)")
    for bad in ("{", "{}", '[{"name": "A"}]', '[{"name": "A", "pattern": "("}]'):
        with pytest.raises(ValueError):
            RuleSet().with_rules_json(bad)
    kept = RuleSet().with_allowlist_json('[{"pattern": "("}, 5, {"pattern": "x"}, {}]')
    assert [a.pattern for a in kept.allow] == ["x"]
    assert RuleSet().with_allowlist_json("nonsense").allow == ()


@pytest.mark.parametrize(
    ("source", "flags", "text", "hit"),
    [
        (r"\bfoo\b", "", "éfoo", True),
        (r"\bfoo\b", "", "_foo", False),
        (r"a\sb", "", "a﻿b", True),
        (r"a\Sb", "", "a b", False),
        (r"end$", "", "end\n", False),
        (r"^b$", "m", "a\nb\nc", True),
        (r"a.b", "", "a b", False),
        (r"a.b", "s", "a\nb", True),
        (r"[[a]", "", "[", True),
        (r"[a&&b]", "", "&", True),
        (r"x[^]y", "", "x\ny", True),
        (r"x[]y|z", "", "xy", False),
        (r"\/\-\_", "", "/-_", True),
        (r"FOO", "i", "foo", True),
        (r"\Bfoo", "", "xfoo", True),
        (r"\b(?:a|b)?c\b", "", "-c", True),
        (r"(\d)\1", "", "a44", True),
    ],
)
def test_regex_dialect(spark, source, flags, text, hit):
    row = spark.range(1).select(F.lit(text).rlike(java_regex(source, flags)).alias("hit")).first()
    assert row.hit is hit


def test_validators(spark):
    df = spark.createDataFrame(
        [("4929-3187-2064-5304", "7382 0516 4941", "127.0.0.1", "0:0:0:0:0:0:0:1"),
         ("4929318720645307", "864209753180", "128.0.0.1", "2001:db8::1"),
         ("42", "7382", "999.1", "::")],
        "card string, aadhaar string, v4 string, v6 string",
    )
    rows = df.select(
        validators.luhn_valid(F.col("card")), validators.verhoeff_valid(F.col("aadhaar")),
        validators.is_public_ipv4(F.col("v4")), validators.is_public_ipv6(F.col("v6")),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (True, True, False, False), (False, False, True, True), (False, False, True, False),
    ]


def test_nested_struct(spark):
    df = spark.sql(
        """select struct(struct('mira.okafor@example.com' as email, '271-63-8054' as ssn) as user,
           'card 4929 3187 2064 5304 on file' as payment, array('a', 'x@y.org') as notes,
           map('k@k.org', 'v 9.18.27.36') as extra, 5 as n, cast(null as string) as nothing) as body"""
    )
    row = redaction.redact_struct(df, "body").first()
    assert row.body.user.email == "[REDACTED_PII_EMAIL]"
    assert row.body.user.ssn == "[REDACTED_PII_SSN]"
    assert row.body.payment == "card [REDACTED_PII_CREDIT_CARD] on file"
    assert row.body.notes == ["a", "[REDACTED_PII_EMAIL]"]
    assert row.body.extra == {"k@k.org": "v [REDACTED_PII_IPV4]"}
    assert (row.body.n, row.body.nothing) == (5, None)
    assert row.matched == {"EMAIL": 2, "SSN": 1, "CREDIT_CARD": 1, "IPV4": 1}


def test_strings_of_a_struct_are_scanned_once(spark):
    df = spark.createDataFrame([("a@b.co",)], "t string").select(F.struct(F.array("t", F.lit("x")).alias("notes")).alias("payload"))
    out = redaction.redact_struct(df, "payload")
    notes = [F.col("payload.notes")[i].alias(f"n{i}") for i in range(2)]
    one, two = (x._jdf.queryExecution().optimizedPlan().toString() for x in (out.select(notes[0]), out.select(*notes, "matched")))
    assert one.count("regexp_extract_all") == two.count("regexp_extract_all") > 0


def test_json_payloads(spark):
    raws = [
        r'{"a": "x@y.org", "x@y.org": {"b": ["q\"\\", "mail z@z.com\nA"], "n": 1.5}}',
        "broken { json but email leaks mira.okafor@example.com here",
        '{"a": 1} mail x@y.org',
        '"x@y.org"',
        "5",
        "",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    rows = redaction.redact_json(df, "raw").orderBy("id").collect()
    assert [r.redacted for r in rows] == [
        r'{"a":"[REDACTED_PII_EMAIL]","x@y.org":{"b":["q\"\\","mail [REDACTED_PII_EMAIL]\nA"],"n":1.5}}',
        "broken { json but email leaks [REDACTED_PII_EMAIL] here",
        '{"a": 1} mail [REDACTED_PII_EMAIL]',
        '"[REDACTED_PII_EMAIL]"',
        "5",
        "",
    ]
    assert [sum(r.matched.values()) for r in rows] == [2, 1, 1, 1, 0, 0]


def test_counts_merge_and_member_edits(spark):
    row = spark.range(1).select(
        spans.merge_counts(F.expr("map('A', 1, 'B', 2)"), F.expr("map('B', 3)")).alias("m"),
        spans.merge_counts(F.lit(None).cast("map<string,int>"), F.expr("map('B', 3)")).alias("n"),
        payload.object_text(
            payload.with_member(payload.members(F.lit('{"b":1,"a":[1,{"c":null}]}')), "b", F.lit('"x"'))
        ).alias("o"),
    ).first()
    assert row.m == {"A": 1, "B": 5} and row.n == {"B": 3}
    assert row.o == '{"b":"x","a":[1,{"c":null}]}'


def test_url_credentials(spark):
    cases = {
        "/v1?key=abc&x=1": "/v1?key=%5BREDACTED%5D&x=1",
        "/v1?x=1": "/v1?x=1",
        "/v1": "/v1",
        "/v1?Token=a&Token=b&q=a+b": "/v1?Token=%5BREDACTED%5D&q=a+b",
        "/v1?api_key": "/v1?api_key=%5BREDACTED%5D",
        "/v1?a=%zz&token=1": "/v1?a=%25zz&token=%5BREDACTED%5D",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.o for r in df.select("p", redact_url_credentials(F.col("p")).alias("o")).collect()}
    assert got == cases


def test_residual(spark):
    df = spark.createDataFrame(
        [("x@y.org",), ("id 4929318720645307",), ("4929318720645304",), ("-----BEGIN RSA PRIVATE KEY-----",), (None,)],
        "t string",
    )
    assert [r[0] for r in df.select(residual_pii(F.col("t"))).collect()] == [True, False, True, True, False]


def test_long_numbers_are_looked_for_where_nine_digits_are(spark):
    rules = {r.name: r for r in RuleSet().active}
    texts = ["12 34, 5.6 or 78", "123-45-6789", "(212) .\n555 - 1234", "4111 1111 1111 1111", "1234\u00a05678-9012", "8.8.8.8", "ABCDE1234F"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    shown = {n: [r[0] for r in df.select(rules[n].guard(F.col("t"))).collect()] for n in ("SSN", "PHONE_US", "CREDIT_CARD", "AADHAAR", "IPV4", "PAN_IN")}
    assert all(shown[n] == [False, True, True, True, True, False, False] for n in ("SSN", "PHONE_US", "CREDIT_CARD", "AADHAAR"))
    assert shown["IPV4"] == [False] * 5 + [True, False] and shown["PAN_IN"] == [False] * 6 + [True]


def test_as_many_splits_as_cores_do_not_show_a_full_cluster(spark):
    cores = spark.sparkContext.defaultParallelism

    def moved(splits: int) -> bool:
        return "hashpartitioning" in spread(spark.range(0, 100, 1, splits), "id")._jdf.queryExecution().executedPlan().toString()

    assert moved(cores) and not moved(2 * cores)
