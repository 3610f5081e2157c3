import random

import pytest

from pyspark.sql import functions as F

from guardlake.functions import messages, routing, transcripts
from guardlake.operators import analytics, files, sequence, traffic, turns
from guardlake.plans import audit_queries, traffic_queries

UP = {"anthropic": "https://a/", "gemini": "https://g", "openai": "https://o"}


def test_routes(spark):
    cases = [
        ("/anthropic/v1/messages?b=1", {}, ("anthropic", "/v1/messages?b=1")),
        ("/openai", {}, ("openai", "/")),
        ("/openaix", {}, None),
        ("/v1/models", {"X-LLM-Provider": "Gemini"}, ("gemini", "/v1/models")),
        ("/v1/messages", {}, ("anthropic", "/v1/messages")),
        ("/x/m:generateContent", {}, ("gemini", "/x/m:generateContent")),
        ("/v1/chat/completions", {"authorization": "Bearer x"}, ("openai", "/v1/chat/completions")),
        ("/v1/models", {"authorization": "bearer x"}, ("anthropic", "/v1/models")),
        ("/models", {"authorization": "Bearer x"}, ("openai", "/models")),
        ("/v1/models", {"x-goog-api-key": "k"}, ("gemini", "/v1/models")),
        ("/health", {}, None),
        ("/health", None, None),
    ]
    df = spark.createDataFrame(
        [(i, u, h) for i, (u, h, _) in enumerate(cases)], "i int, url string, headers map<string,string>"
    )
    rows = df.orderBy("i").select(routing.route_request(F.col("url"), F.col("headers"), UP).alias("r")).collect()
    assert [(r.r.provider, r.r.forward_path) if r.r else None for r in rows] == [c[2] for c in cases]


def test_headers_and_loopback(spark):
    row = spark.range(1).select(
        routing.forwardable_headers(
            F.expr("map('Host','h','X-A','1','Proxy-B','2','x-llm-provider','p','Accept-Encoding','gzip')")
        ).alias("h"),
        *[routing.is_loopback(F.lit(u)) for u in
          ("http://localhost:1", "http://127.9.0.1/x", "http://[::1]:2", "http://10.0.0.1", "nonsense", "http://127.0.0.1.evil.example")],
    ).first()
    assert row[0] == {"x-a": "1", "accept-encoding": "identity"}
    assert list(row[1:]) == [True, True, True, False, False, False]


def test_labels_and_sites(spark):
    def one(*columns):
        return list(spark.range(1).select(*columns).first())

    assert one(
        routing.model_label(F.lit("chatgpt"), F.lit("ChatGPT 5 Thinking")),
        routing.model_label(F.lit("chatgpt"), F.lit("GPT-4o")),
        routing.model_label(F.lit("grok"), F.lit("Fast")),
        routing.model_label(F.lit("gemini"), F.lit("2.5 Pro")),
        routing.model_label(F.lit("gemini"), F.lit("?")),
    ) == ["chatgpt-5-thinking", "gpt-4o", "grok-fast", "gemini-pro", "gemini"]
    assert one(
        routing.site_of_host(F.lit("x.grok.com")), routing.site_of_host(F.lit("notgrok.com")),
        routing.surface_of(F.lit("CHAT"), F.lit("grok-web-extension"), F.lit("openai")),
        routing.surface_of(F.lit("POST"), F.lit("/v1"), F.lit("anthropic")),
    ) == ["grok", "gemini", "grok", "claude-code"]


def test_clean_view(spark):
    body = (
        '{"messages":[{"role":"user","content":"old"},{"role":"user","content":[{"type":"text","text":'
        '"<system-reminder>x\\ny</system-reminder> Hello "},{"type":"image"}]},{"role":"user","content":"<session></session>"}]}'
    )
    sse = 'event: x\ndata: {"type":"content_block_delta","delta":{"text":"a"}}\n\ndata: {cut\n\ndata: {"type":"content_block_delta","delta":{"text":"b"}}\n'
    row = spark.range(1).select(
        messages.user_prompt(F.lit(body)),
        messages.user_prompt(F.lit("{cut")),
        messages.assistant_output(F.lit("anthropic"), F.lit(sse)),
        messages.assistant_output(F.lit("anthropic"), F.lit('{"content":[{"text":"x"},{"n":1},{"text":"y"}]}')),
        messages.assistant_output(F.lit("openai"), F.lit('{"choices":[{"text":"z"}]}')),
        messages.assistant_output(F.lit("gemini"), F.lit('{"candidates":[]}')),
    ).first()
    assert row[0] == "Hello" and row[1].startswith("(could not parse request")
    assert list(row[2:5]) == ["ab", "xy", "z"] and row[5] == "(no assistant text found)"


def test_empty_blocks(spark):
    body = (
        '{"messages":[{"role":"user","content":[{"type":"text","text":" "},{"type":"text","text":"a"}]},'
        '{"role":"user","content":[{"type":"text"}]},{"role":"user","content":"s"}],"system":[{"type":"text","text":""}]}'
    )
    got = spark.range(1).select(messages.drop_empty_blocks(F.lit(body)).alias("b")).first().b
    assert got == (
        '{"messages":[{"content":[{"text":"a","type":"text"}],"role":"user"},'
        '{"content":[{"type":"text","text":" "}],"role":"user"},{"content":"s","role":"user"}],"system":[{"type":"text","text":" "}]}'
    )


def test_decisions_hold_no_raw_values(spark):
    df = spark.sql(
        """select * from values (1, null, 'x@y.org', null, 'maybe', array('EMAIL','x@y.org','EMAIL'), -3.5D),
        (2, null, '', 'incoming', 'blocked', null, double('nan')) as t(event_id, ts, surface, direction, decision, pii_types, latency_ms)"""
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = traffic.normalize_decisions(df, F.timestamp_seconds(F.lit(5))).orderBy("event_id").collect()
    assert rows[0].pii_types == ["EMAIL"] and rows[0].rule_matched == "EMAIL" and rows[0].latency_ms == 0
    assert (rows[0].direction, rows[0].decision) == ("outgoing", "allowed")
    assert rows[1].surface == "unknown" and rows[1].pii_types == [] and rows[1].rule_matched is None
    assert rows[1].latency_ms is None and rows[1].ts.timestamp() == 5


def test_traffic_holds_redacted_text_only(spark):
    sse = "".join(
        'data: {"choices":[{"delta":{"content":"%s"}}]}\n\n' % piece for piece in ("mail jo", "hn@exam", "ple.com ok")
    )
    df = spark.createDataFrame(
        [(1, "openai", '{"messages":[{"role":"user","content":"ssn 271-63-8054"}]}', sse + "data: [DONE]\n\n"),
         (2, "anthropic", "mail a@b.org", '{"content":[{"type":"text","text":"ip 9.18.27.36"}]}')],
        "id long, provider string, request string, response string",
    ).withColumns({
        "ts": F.timestamp_seconds(F.lit(0)), "model": F.lit("m"), "blocked": F.lit(None).cast("boolean"),
        "method": F.lit("POST"), "path": F.lit("/x?token=t"), "status": F.lit(200), "streaming": F.lit(True),
        "duration_ms": F.lit(1).cast("bigint"),
    })
    out = traffic.build_traffic(df)
    rows = out.orderBy("id").collect()
    dump = str(rows)
    for raw in ("271-63-8054", "john@", "example.com", "a@b.org", "9.18.27.36", "token=t"):
        assert raw not in dump
    assert rows[0].clean.assistant_output == "mail [REDACTED_MOCK_PII] ok"
    assert rows[0].clean.user_prompt == "ssn [REDACTED_PII_SSN]"
    assert rows[0].matched.outbound == {"EMAIL": 1}
    decisions = traffic.to_decisions(out).orderBy("event_id").collect()
    assert [sorted(d.pii_types) for d in decisions] == [["EMAIL", "SSN"], ["EMAIL", "IPV4"]]
    assert {d.decision for d in decisions} == {"redacted"}


def test_bodies_that_are_no_streams_do_not_meet_in_one_task(spark, monkeypatch):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for key, value in zip(kept, ("false", "-1")):
        spark.conf.set(key, value)
    try:
        df = spark.range(64).select(
            "id", F.lit("anthropic").alias("provider"), F.lit("{}").alias("request"),
            F.format_string('{"content":[{"type":"text","text":"ip 9.18.27.%d"}]}', "id").alias("response"),
        ).withColumns({
            "ts": F.timestamp_seconds(F.lit(0)), "model": F.lit("m"), "blocked": F.lit(False), "method": F.lit("POST"), "path": F.lit("/x"),
            "status": F.lit(200), "streaming": F.lit(False), "duration_ms": F.lit(1).cast("bigint"),
        })
        out = traffic.build_traffic(df).select("id", "matched", F.spark_partition_id().alias("task")).collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert sorted(r.id for r in out) == list(range(64)) and all(r.matched.outbound == {"IPV4": 1} for r in out)
    assert len({r.task for r in out}) > 1


def test_blocks_are_parsed_once_for_all_columns(spark, sf):
    plan = traffic_queries.dropped_blocks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("parseJson") < 10


def test_surface_policy(spark):
    sends = spark.createDataFrame([("gemini", "x"), ("grok", "x"), ("cursor", " "), ("new", "x")], "surface string, text string")
    config = spark.createDataFrame([("gemini", True, "off"), ("grok", False, "off")], "surface string, enabled boolean, mode string")
    got = {r.surface: r.outcome for r in traffic.apply_surface_policy(sends, config).collect()}
    assert got == {"gemini": "raw", "grok": "blocked", "cursor": "raw", "new": "redact"}


def test_running_sums_over_a_hot_key(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.col("id").alias("pos"), (F.col("id") % 7).alias("v"))
    out = sequence.running_sums(df, ["key"], "pos", {"before": F.col("v")}, block=64).orderBy("pos").collect()
    total = 0
    for row in out:
        assert row.before == total
        total += row.v


LINES = [
    '{"role":"user","message":{"content":[{"type":"text","text":"<user_query> one </user_query>"}]}}',
    '{"role":"user","message":{"content":"<timestamp>t</timestamp> two <attached_files>x@y.org</attached_files>"}}',
    '{"role":"assistant","message":{"content":[{"type":"text","text":"A"},{"type":"tool_use","text":"no"}]}}',
    '{"role":"assistant","message":{"content":"B"}}',
    '{"type":"turn_ended"}',
    '{"type":"turn_ended"}',
    '{"role":"user","message":{"content":"<user_query>three</user_query><user_query> </user_query>"}}',
    '{"role":"us',
]


def lines_frame(spark, lines=LINES):
    return spark.createDataFrame([("p", i, v) for i, v in enumerate(lines)], "path string, pos int, value string")


def test_turns(spark):
    lines = lines_frame(spark)
    rows = turns.build_turns(lines).orderBy("turn").collect()
    assert [(r.prompt, r.response, r.scan_extra, r.unchecked) for r in rows] == [
        ("one\n\ntwo", "AB", "x@y.org", False), ("", "", "", False),
    ]
    cut = turns.build_turns(lines, cap=4).orderBy("turn").first()
    assert (cut.prompt, cut.response, cut.scan_extra) == ("one\n", "AB", "x@y.")
    assert [r.text for r in turns.pending_messages(lines).collect()] == ["three"]
    fresh = turns.new_turns(turns.build_turns(lines), spark.createDataFrame([], "path string, turn_hash string"))
    assert fresh.count() == 1


def test_unchecked_needs_a_ledger(spark):
    ledger = spark.createDataFrame([("one",)], "t string").select(turns.prompt_hash(F.col("t")).alias("hash"))
    assert turns.build_turns(lines_frame(spark), ledger).orderBy("turn").first().unchecked is True
    assert turns.build_turns(lines_frame(spark), ledger.limit(0)).orderBy("turn").first().unchecked is False


def test_leaks(spark):
    df = spark.createDataFrame(
        [(1, "x@y.org", "", False), (2, "x@y.org", "", True), (3, "hi", "x@y.org", False), (4, "x@y.org", "clean", False), (5, "hi", "", True)],
        "turn int, prompt string, scan_extra string, unchecked boolean",
    ).withColumn("response", F.lit(""))
    logged = turns.log_turns(df)
    assert {r.turn: r.unchecked for r in logged.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
    assert sorted(r.turn for r in turns.confirmed_leaks(logged).collect()) == [2, 3, 4]


def brute_attach(flags, asked, ring):
    taken, pairs = set(), {}
    for turn in sorted(asked, key=lambda t: (t["after_seq"], t["turn_id"])):
        hay = turn["prompt"].strip()
        for flag in sorted((f for f in flags if f["surface"] == turn["surface"]), key=lambda f: -f["seq"]):
            if not turn["after_seq"] - ring <= flag["seq"] < turn["after_seq"] or flag["seq"] in taken:
                continue
            needle = flag["raw_prompt"].strip()
            if needle and hay and needle in hay:
                taken.add(flag["seq"])
                pairs[flag["seq"]] = turn["turn_id"]
                break
    return pairs


def test_attach_responses_against_brute_force(spark):
    rnd = random.Random(5)
    # One surface and one prompt hold most rows.
    words = ["go"] * 6 + ["stop", "go on", "", "why go"]
    flags, asked = [], []
    for seq in range(600):
        surface = "hot" if rnd.random() < 0.8 else "cold"
        if rnd.random() < 0.5:
            flags.append({"log_id": 1, "surface": surface, "seq": seq, "raw_prompt": rnd.choice(words)})
        else:
            prompt = "\n\n".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
            asked.append({"log_id": 1, "surface": surface, "turn_id": seq, "after_seq": seq, "prompt": prompt, "response": f"r{seq}"})
    f = spark.createDataFrame(flags, "log_id int, surface string, seq long, raw_prompt string")
    t = spark.createDataFrame(asked, "log_id int, surface string, turn_id long, after_seq long, prompt string, response string")
    for ring in (7, 50):
        out = turns.attach_responses(f, t, ring).collect()
        assert len(out) == len(flags)
        got = {r.seq: r.turn_id for r in out if r.turn_id is not None}
        assert got == brute_attach(flags, asked, ring)
        assert all(r.response == f"r{r.turn_id}" for r in out if r.turn_id is not None)


def test_replies_are_matched_without_broadcasts(spark):
    f = spark.range(200).select(F.lit(1).alias("log_id"), F.lit("s").alias("surface"), (F.col("id") * 2).alias("seq"), F.format_string("ask user %d.", "id").alias("raw_prompt"))
    t = spark.range(200).select(
        F.lit(1).alias("log_id"), F.lit("s").alias("surface"), F.col("id").alias("turn_id"), (F.col("id") * 2 + 1).alias("after_seq"),
        F.format_string("first ask user %d. last", "id").alias("prompt"), F.lit("r").alias("response"),
    )
    out = turns.attach_responses(f, t)
    assert {r.seq: r.turn_id for r in out.collect()} == {2 * i: i for i in range(200)}
    # Whatever the size, no table that grows with the input goes through the driver.
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("steps,windows", [([0, 1, 500, 5_000, 30_000, 70_000, 200_000], 64), ([0, 1, 500, 5_000, 9_000, 11_000], 1)])
def test_attempts_against_brute_force(spark, monkeypatch, steps, windows):
    """With short steps the hot key never pauses for a window, over hundreds of blocks."""
    monkeypatch.setattr(analytics, "BLOCK_WINDOWS", windows)
    rnd = random.Random(9)
    rows, at = [], 0
    for i in range(3000):
        at += rnd.choice(steps)
        rows.append((i, "hot" if rnd.random() < 0.7 else f"k{i % 5}", at))
    admitted, want = {}, {}
    for i, key, t in rows:
        mine = [x for x in admitted.get(key, []) if t - x < 60_000]
        want[i] = len(mine) < 5
        admitted[key] = mine + [t] if want[i] else mine
    df = spark.createDataFrame(rows, "attempt_id int, key string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r.attempt_id: r.admitted for r in analytics.allowed_attempts(df).collect()}
    assert got == want and not all(want.values())


def test_replies(spark):
    base = dict(turn_id=1, grew=False, growth_steps=0, follows_prompt=True, contains_prompt=False,
                interactive=False, interactive_ratio=0.0, appeared=False, visible=True)
    long = "This is a long enough answer " * 5
    rows = [
        {**base, "pos": 0, "text": "Gemini can make mistakes, so double-check its responses", "appeared": True},
        {**base, "pos": 1, "text": "You, 1 min", "appeared": True},
        {**base, "pos": 2, "text": "Gemini response " + long, "grew": True, "growth_steps": 3, "appeared": True},
        {**base, "pos": 3, "text": long, "appeared": True},
        {**base, "pos": 4, "text": "chip", "interactive": True, "appeared": True},
        {**base, "turn_id": 2, "pos": 0, "text": "short"},
    ]
    out = {r.turn_id: r for r in turns.pick_reply(spark.createDataFrame(rows)).collect()}
    assert out[1].pos == 2 and out[1].reply == long.strip()
    assert out[2].pos is None and out[2].reply is None
    labels = spark.range(1).select(
        transcripts.strip_reply_label(F.lit("Show thinking")), transcripts.strip_reply_label(F.lit("show thinking\nX"))
    ).first()
    assert list(labels) == [None, "X"]


def test_files(spark):
    cases = [
        ("a.txt", "", 10, "text"), ("payroll.pdf", "text/plain", 10, "binary-extension"), ("b.docx", "", 9 << 20, "too-large"),
        ("b.docx", "", 10, "ooxml"), ("c.csv", "", 3 << 20, "too-large"), ("x", "", 1, "unknown-type"),
        ("x.zzz", "", 1, "unsupported-type"), (".gitignore", "", 1, "text"), ("x", "application/ld+json", 1, "text"),
    ]
    df = spark.createDataFrame([(i, n, m, s) for i, (n, m, s, _) in enumerate(cases)], "i int, name string, mime string, size long")
    assert [r.reason for r in files.classify_files(df, 2 << 20, 8 << 20).orderBy("i").collect()] == [c[3] for c in cases]


def test_office_runs_are_joined(spark):
    xml = (
        '<w:p><w:r><w:t>mail dana@</w:t></w:r><w:r><w:t xml:space="preserve">corp.example &amp;lt; &#233;&#128512;</w:t></w:r></w:p>'
        "<w:p/><w:p></w:p><w:p><w:r>no text</w:r></w:p><si><t>x</t></si>"
    )
    parts = spark.createDataFrame([(1, 0, "word/document.xml", xml)], "file_id int, part_at int, part string, xml string")
    rows = files.office_paragraphs(parts, ["file_id"]).orderBy("at").collect()
    assert [r.text for r in rows] == ["mail dana@corp.example &lt; é😀", "x"]


def test_office_runs_are_looked_for_once(spark):
    xml = "<w:p>" + "<w:r><w:t>a &lt; b</w:t></w:r>" * 3 + "</w:p><w:p a='1'><w:t>x<y></w:t></w:p><w:p>" + "<w:p " * 3 + "<w:t>open"
    parts = spark.createDataFrame([(1, 0, "word/document.xml", xml)], "file_id int, part_at int, part string, xml string")
    found = files.office_paragraphs(parts, ["file_id"])
    assert [r.text for r in found.orderBy("at").collect()] == ["a < ba < ba < b", "x<y>"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?:w|a):t") == 1


def test_config(spark):
    history = spark.sql(
        """select * from values (1, 'gemini', 'block', cast(null as boolean), 'a'), (2, 'gemini', null, false, 'b'),
        (3, 'cursor', 'redact', null, 'c') as t(seq, surface, mode, enabled, admin)"""
    ).withColumns({"ts": F.timestamp_seconds("seq"), "pii_type_toggles": F.lit(None).cast("map<string,boolean>"),
                   "fail_mode": F.lit(None).cast("string")})
    checked = {r.seq: r.error for r in analytics.validate_modes(history).collect()}
    assert checked[1] is None and "not valid for cursor" in checked[3]
    config = analytics.surface_config(history.where("seq < 3"), analytics.surface_catalog(spark))
    got = {r.surface: (r.enabled, r.mode, r.updated_by) for r in config.collect()}
    assert got["gemini"] == (False, "block", "b") and got["cursor"] == (True, "block", "system")
    patch = history.where("seq = 2").withColumn("mode", F.lit("off"))
    settings, audit = analytics.apply_config_patch(config, patch)
    assert {r.surface: r.mode for r in settings.collect()}["gemini"] == "off"
    (row,) = audit.collect()
    assert '"mode":"block"' in row.before_value and '"mode":"off"' in row.after_value


def test_audit_log_files_reads_the_whole_log(spark, tmp_path):
    n = 100_050
    events = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit(6).cast("bigint").alias("user_id")
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    counts = {(r.action, r.target): r.n for r in audit_queries.audit_log_files(spark, str(tmp_path)).collect()}
    assert {a: sum(c for (b, _), c in counts.items() if b == a) for a, _ in counts} == {
        "rules.update": n // 3, "surface_config.update": n - n // 3
    }


def _archive(name="word/document.xml", text="mail a@b.org"):
    import io
    import zipfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(name, f"<w:document><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:document>")
    return packed.getvalue()


def test_every_office_file_is_decided_by_itself(spark):
    from guardlake.operators import files
    from guardlake.plans.pii_queries import _spoilt

    whole = _archive()
    cases = {
        "found": (whole, "block", "pii-not-rewritten"),
        "clean": (_archive(text="nothing"), "allow", "no-pii"),
        "textless": (_archive("word/media.xml"), "allow", "no-text"),
        "damaged": (_spoilt(whole, 3), "block", "upload-unreadable"),
        "encrypted": (_spoilt(whole, 5), "block", "upload-unreadable"),
        "cut": (whole[:60], "block", "upload-unreadable"),
        "junk": (b"PK", "block", "upload-unreadable"),
        "null": (None, "block", "upload-unreadable"),
    }
    rows = [(k, "a.docx", "", len(c or b""), bytearray(c) if c is not None else None) for k, (c, _, _) in cases.items()]
    df = spark.createDataFrame(rows, "file_id string, name string, mime string, size long, content binary")
    out = {r.file_id: r for r in files.redact_files(df).collect()}
    assert {k: (r.action, r.reason) for k, r in out.items()} == {k: (a, w) for k, (_, a, w) in cases.items()}
    assert all(r.text is None for r in out.values()) and out["found"].paragraphs == 1
    small = files.redact_files(df, office_most=10).where("file_id = 'clean'").first()
    assert (small.action, small.reason, small.detail) == ("block", "upload-unscannable", "too-large")


def test_a_surface_keeps_its_last_policy(spark):
    from guardlake.operators import traffic

    sends = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], "surface string, text string")
    config = spark.createDataFrame([("a", True, "off")], "surface string, enabled boolean, mode string")
    past = [("a", 1, False, "block"), ("b", 1, None, "block"), ("b", 2, True, None), ("c", 1, True, "block"), ("c", 2, None, "off")]
    history = spark.createDataFrame(past, "surface string, seq long, enabled boolean, mode string")
    out = {r.surface: r.outcome for r in traffic.apply_surface_policy(sends, config, history).collect()}
    assert out == {"a": "raw", "b": "blocked", "c": "raw", "d": "redact"}


def test_limits_are_arguments(spark):
    from guardlake.operators import analytics, codescan, redaction, turns

    code = spark.createDataFrame([("c", "x = 1\n" * 60_000 + "eval(formula)\n")], "conv_id string, content string")
    assert codescan.scan_lines(code, "content", ["conv_id"]).count() == 1
    assert codescan.scan_lines(code, "content", ["conv_id"], cap=1000).count() == 0
    found = spark.range(300).selectExpr("'c' as conv_id", "'k' as category", "cast(id as int) as line", "'m' as message", "1 as tier", "id as seq")
    assert codescan.accumulate_findings(found, "seq").count() == 300
    assert codescan.accumulate_findings(found, "seq", cap=20).agg({"nth": "max"}).first()[0] == 20
    log = spark.range(500).selectExpr("id", "timestamp_seconds(id) as ts", "id = 3 as pii_detected")
    assert [r.id for r in analytics.recent(log, 5, only_pii=True).collect()] == [3]
    assert analytics.recent(log, 5).count() == 5
    events = log.withColumnRenamed("id", "event_id")
    assert analytics.query_events(events).count() == 500 and analytics.query_events(events, 7).count() == 7
    done = spark.range(30).selectExpr("'p' as path", "cast(id as string) as prompt", "'' as response", "id as turn")
    none = spark.createDataFrame([], "path string, turn_hash string, nth long")
    assert turns.kept_hashes(done, none).count() == 30 and turns.kept_hashes(done, none, keep=4).count() == 4
    prompt = " ".join(f"@f{i}" for i in range(25))
    prompts = spark.createDataFrame([("s", prompt)], "id string, prompt string")
    names = spark.createDataFrame([(f"f{i}",) for i in range(25)], "path string")
    assert redaction.extract_mentions(prompts, names, "id", "prompt").count() == 25
    assert redaction.extract_mentions(prompts, names, "id", "prompt", most=20).count() == 20


def test_payload_shapes_of_any_depth(spark):
    from guardlake.operators import redaction

    raw = '{"a":[1,"x\\"]{",{"b":{"c":[[null]]}}],"n":' + str(list(range(12))) + "}"
    df = spark.createDataFrame([(1, raw), (2, "[true]"), (3, "no json {{{"), (4, None)], "id int, raw string")
    rows = {(r.id, r.path): (r.kind, r["size"]) for r in redaction.payload_shape(df, "raw", ["id"]).collect()}
    assert rows[1, "a"] == ("array", 3) and rows[1, "a[1]"] == ("string", 4) and rows[1, "a[2].b"] == ("object", None)
    assert rows[1, "a[2].b.c[0][0]"] == ("null", None) and rows[1, "n[11]"] == ("number", None) and rows[1, "n"] == ("array", 12)
    assert rows[2, ""] == ("array", 1) and rows[2, "[0]"] == ("boolean", None) and {k for k, _ in rows} == {1, 2}


def test_archives_are_opened_once(spark):
    """What is read of archives and whether they could be read comes from one pass over them."""
    import io
    import zipfile

    from guardlake.operators import files

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("word/document.xml", "<w:p><w:r><w:t>mail a@b.org</w:t></w:r></w:p>")
    kinds = "file_id bigint, name string, mime string, size bigint, content binary"
    rows = [(1, "a.docx", "", 10, packed.getvalue()), (2, "b.docx", "", 10, b"broken"), (3, "c.txt", "", 5, b"plain")]
    out = files.redact_files(spark.createDataFrame([(i, n, m, s, bytearray(c)) for i, n, m, s, c in rows], kinds))
    assert "MapInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["file_id"]: (r["action"], r["paragraphs"]) for r in out.collect()}
    assert got[1] == ("block", 1) and got[2][0] == "block" and got[3][0] != "block"
