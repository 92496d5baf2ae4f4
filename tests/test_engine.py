import json

import pytest
from pyspark.sql import functions as F

from docvet.operators import gate, logs, policy, reports
from docvet.plans.engine import Engine
from docvet.sources import readers
from docvet.streaming import streams
from tests.files import FILES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    for name, (content, *_) in FILES.items():
        (top / name).write_bytes(content)
    return str(top)


@pytest.fixture(scope="module")
def verdicts(spark, folder):
    return Engine(spark).process(folder).withColumn("name", F.element_at(F.split("path", "/"), -1)).cache()


def test_every_format(verdicts):
    got = {r["name"]: r for r in verdicts.collect()}
    assert set(got) == set(FILES)
    for name, (_, ids, label, action) in FILES.items():
        r = got[name]
        assert ([e.detector_id for e in r.evidence], r.label, r.decision.action) == (ids, label, action), (name, r.error, r.evidence)
    assert {n for n, r in got.items() if r.error} == {"broken.docx", "old.xls", "binary.py", "unknown.bin"}
    assert got["broken.docx"].error.kind == "parse_failed" and got["unknown.bin"].error.kind == "unsupported_format"
    assert got["broken.docx"].decision.rule_id == "POL-000" and got["disguised.txt"].kind == "docx"


def test_places_and_raw_values(verdicts):
    got = {r["name"]: r for r in verdicts.collect()}
    zero = got["zero.docx"].evidence[0]
    assert (zero.start, zero.end, zero.raw["codepoint"], zero.raw["name"]) == (7, 8, "U+200B", "ZERO WIDTH SPACE")
    order = got["order.py"].evidence[0]
    assert (order.paragraph, order.severity, order.raw["class"], order.element) == (4, "critical", "command_injection", "line:4")
    rows = got["row.xlsx"].evidence[1]
    assert (rows.sheet, rows.row, rows.raw["rows"]) == ("A", 2, "2")
    assert got["notes.pptx"].evidence[0].element == "notes:slide1" and got["noted.pdf"].evidence[0].page == 1
    assert got["clear.pdf"].evidence[0].raw["text"] == "unseen"


def test_sanitized_text(spark, folder, verdicts):
    got = {r["name"]: r.sanitized for r in verdicts.collect()}
    assert got["zero.docx"].text == "Good work done" and got["hidden.html"].text == "three" and got["sheet.xlsx"].text == "x"
    assert got["order.py"].text == "import x\nx = 1  # TODO: run the command\n# [docvet] removed untrusted instruction (class=command_injection)"
    assert [(x.type, x.location) for x in got["order.py"].removed] == [("comment_directive", "4")]
    assert got["clear.pdf"].text == "Plain" and [x.type for x in got["sheet.xlsx"].removed] == ["hidden_sheet"]
    red = {r.path.rpartition("/")[2]: r.text for r in Engine(spark, mode="redact").sanitized(folder).collect()}
    assert red["hidden.html"] == "[REDACTED]\n[REDACTED]\nthree" and red["white.docx"].startswith("[REDACTED]\n")


def test_scan_trust_policy_and_views(spark, folder, verdicts, tmp_path):
    engine = Engine(spark)
    scans = {r.path.rpartition("/")[2]: r for r in engine.scan(folder, severity="high", skip=("DET-001",)).collect()}
    assert [scans[n].exit_code for n in ("benign.docx", "zero.docx", "white.docx", "tiny.docx", "broken.docx")] == [0, 0, 1, 0, 3]
    report = json.loads(scans["white.docx"].report)
    assert report["summary"]["high"] == 1 and report["trust_label"] is None and report["scan"]["status"] == "ok" and report["evidence"][0]["location"]["sheet"] is None
    trust = {r.path.rpartition("/")[2]: r for r in engine.trust(folder).collect()}
    assert [float(trust[n].score) for n in ("benign.docx", "comment.html", "tiny.docx", "white.docx", "script.html", "meta.htm", "broken.docx")] == [1.0, 0.6, 0.6, 0.39, 0.94, 0.88, 0.0]
    engine.policy(folder, audit=str(tmp_path / "audit")).count()
    tail = engine.audit_tail(str(tmp_path / "audit"), 5).collect()
    assert len(tail) == 5 and logs.read(spark, str(tmp_path / "audit")).count() == len(FILES)
    engine.views(verdicts)
    n = spark.sql("select count(*) n from evidence e join verdicts v using (path) where e.severity = 'high' and v.label = 'dangerous'").first().n
    assert n == sum(i in ("DET-001", "DET-002", "DET-009") for f in FILES.values() for i in f[1])
    assert reports.filtered(verdicts, "high").select(F.sum(F.size("evidence"))).first()[0] == n + 2  # two critical comments
    assert spark.table("runs").count() > 40 and engine.detectors().count() == 9


def test_own_rules_and_skipping(spark, folder):
    rules = policy.Policy([policy.Rule("A", "human_approval", "tiny", policy.detector_hit("DET-003")), policy.Rule("B", "block", "null test", F.lit(None).cast("boolean"))])
    got = {r.path.rpartition("/")[2]: r.decision for r in Engine(spark, rules=rules).process(folder, skip=("DET-008",)).select("path", "decision").collect()}
    assert got["tiny.pdf"].rule_id == "A" and got["order.py"].rule_id == "fallback-allow" and got["broken.docx"].action == "allow"


def test_approvals(spark, folder, tmp_path):
    path = str(tmp_path / "approvals")
    rules = policy.Policy([policy.Rule("H", "human_approval", "look", policy.any_evidence())])
    requests = logs.approval_requests(Engine(spark, rules=rules).process(folder))
    logs.append(requests, path)
    engine = Engine(spark)
    first = engine.approvals(path).orderBy("file").first()
    assert engine.decide(path, first.id, "approved", "ann") == 1 and engine.decide(path, first.id, "rejected", "bob") == 0 and engine.decide(path, "none", "approved", "ann") == 0
    state = {r.id: r.status for r in logs.current(logs.read(spark, path, logs.APPROVAL)).collect()}
    assert state[first.id] == "approved" and sum(s == "pending" for s in state.values()) == len(state) - 1


def test_incremental(spark, folder, tmp_path):
    engine = Engine(spark)
    none = spark.createDataFrame([], "namespace string, path string, length long, sha256 string, action string, label string, rule_id string")
    hits, fresh = engine.incremental(folder, none)
    assert hits.count() == 0
    cache = logs.cache_entries(fresh, logs.namespace())
    cache.write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    changed = cache.withColumn("sha256", F.when(F.col("path").endswith("benign.py"), "other").otherwise(F.col("sha256")))
    hits, fresh = engine.incremental(folder, changed)
    assert hits.count() == len(FILES) - 1 and [r.path.rpartition("/")[2] for r in fresh.select("path").collect()] == ["benign.py"]
    assert engine.incremental(folder, cache.withColumn("namespace", F.lit("old")))[0].count() == 0
    assert {r.sanitized_text == "" for r in cache.filter("action <> 'quarantine'").collect()} == {True}


def test_gate(spark, verdicts):
    paths = {r["name"]: r.path for r in verdicts.select("name", "path").collect()}
    asked = [("PreToolUse", "Read", paths[n]) for n in ("benign.docx", "white.docx", "tiny.docx", "disguised.txt", "broken.docx")]
    asked += [("PreToolUse", "Read", "/x/none.docx"), ("PreToolUse", "Read", "/x/none.txt"), ("PreToolUse", "Write", paths["white.docx"]), ("PostToolUse", "Read", "x"), ("PreToolUse", "Read", None)]
    calls = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, event string, tool string, path string")
    got = gate.pre_read(calls, verdicts).orderBy("id").collect()
    assert [r.outcome for r in got] == ["allow", "deny", "allow", "deny", "deny", "deny", "allow", "allow", "allow", "allow"]
    assert [r.rule for r in got][1:5] == ["POL-001", "POL-002", "POL-001", "POL-000"] and got[2].new_path.startswith("quarantine/")
    assert "DET-003/tiny_font medium" not in got[2].reason and "DET-002/hidden_style high @ white.docx: para 0, run 0" in got[1].reason
    open_ = {r.id: r.outcome for r in gate.pre_read(calls, verdicts, gate.Settings(fail_closed=False, substitute=False, most_bytes=10)).collect()}
    assert open_[5] == "allow" and open_[0] == "allow"
    answer = json.loads(gate.pre_read(calls, verdicts).withColumn("j", gate.rendered(F.lit(1))).filter("id = 2").first().j)["hookSpecificOutput"]
    assert answer["permissionDecision"] == "allow" and answer["updatedInput"]["file_path"].startswith("quarantine/")


def test_post_tool(spark):
    many = json.dumps({"a": ["x"] * 64 + ["​"]})
    rows = [(1, '{"a": ["x​", {"b​": "‮\\u200c"}], "n": 1}'), (2, '{"a": "clean"}'), (3, "no json"), (4, None), (5, many), (6, '["say \\"hi\\": \\u200b"]')]
    got = {r.id: (r.n_invisible, r.n_bidi, r.context is not None) for r in gate.post_tool(spark.createDataFrame(rows, "id int, response string"), "response").collect()}
    assert got == {1: (2, 1, True), 2: (0, 0, False), 3: (0, 0, False), 4: (0, 0, False), 5: (0, 0, False), 6: (1, 0, True)}


def test_streams(spark, folder, verdicts, tmp_path):
    out = {k: str(tmp_path / k) for k in ("scan", "gate", "post", "in")}
    streams.scan_stream(spark, folder, out["scan"], out["scan"] + "_c", files_per_batch=10).awaitTermination()
    scanned = spark.read.parquet(out["scan"])
    assert {r.source: r.label for r in scanned.collect()} == {n: f[2] for n, f in FILES.items()} and scanned.select("batch").distinct().count() > 1
    path = verdicts.filter("name = 'white.docx'").first().path
    events = [("1", "PreToolUse", "Read", path, None), ("2", "PostToolUse", "Read", None, '["​"]')]
    spark.createDataFrame(events, streams.PAYLOAD).write.json(out["in"])
    streams.gate_stream(streams.payloads(spark, out["in"]), verdicts, out["gate"], out["gate"] + "_c").awaitTermination()
    assert {r.id: r.outcome for r in spark.read.parquet(out["gate"]).collect()} == {"1": "deny", "2": "allow"}
    streams.post_tool_stream(streams.payloads(spark, out["in"]), out["post"], out["post"] + "_c").awaitTermination()
    assert [(r.id, r.n_invisible) for r in spark.read.parquet(out["post"]).collect()] == [("2", 1)]


def test_source_walk_and_size_guard(spark, tmp_path):
    for name in ("a.py", "node_modules/b.py", "dist/c.py", "notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("# x\n" * 100)
    found = readers.files(spark, str(tmp_path))
    names = lambda df: sorted(r.path.rpartition("/")[2] for r in df.collect())
    assert names(readers.source_files(found)) == ["a.py"] and names(readers.source_files(found, with_builds=True)) == ["a.py", "c.py"]
    large = Engine(spark, most_bytes=10).process(str(tmp_path / "a.py")).first()
    assert large.error.kind == "parse_failed" and large.decision.action == "block"


def test_stream_keeps_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams.fixed, "MOST_FILE_BYTES", 100)
    (tmp_path / "in").mkdir()
    for name, n in (("small.py", 10), ("large.py", 200)):
        (tmp_path / "in" / name).write_text("a = 1\n" * (n // 6))
    streams.scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r.source: r.label for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"small.py", "large.py"} and got["large.py"] == "dangerous" != got["small.py"]


def test_pdf_text_that_cannot_be_read_fails_closed():
    from docvet.sources import binary

    def made(font, form="/Image"):
        objects = [
            "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] >>",
            "<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /X1 6 0 R >> >> >>",
            "<< >> stream\nBT /F1 12 Tf (a) Tj ET /X1 Do\nendstream", f"<< /Type /Font {font} >>", f"<< /Subtype {form} >> stream\nBT (b) Tj ET\nendstream",
        ]
        return ("%PDF-1.4\n" + "".join(f"{i} 0 obj {o} endobj\n" for i, o in enumerate(objects, 1))).encode()

    plain = "/Subtype /Type1 /Encoding /WinAnsiEncoding"
    assert binary.read("pdf", "x.pdf", made(plain))["error"] is None
    for data in (made(plain, "/Form"), made("/Subtype /Type0 /Encoding /Identity-H"), made("/Subtype /TrueType /Encoding << /Differences [65 /B] >>")):
        assert binary.read("pdf", "x.pdf", data)["error"]["kind"] == "parse_failed"


def test_pdf_matrices_and_filters():
    import base64
    import zlib

    from docvet.sources import binary
    from tests.files import pdf

    def sizes(content):
        return [r["font_size"] for r in binary.read("pdf", "x.pdf", pdf(content))["paragraphs"][0]["runs"]]

    assert sizes("q 0.1 0 0 0.1 0 0 cm BT /F1 12 Tf (a) Tj ET Q BT /F1 12 Tf (b) Tj ET") == pytest.approx([1.2, 12])
    assert sizes("q .5 0 0 .5 0 0 cm .2 0 0 .2 9 9 cm BT /F1 1 Tf 0 12 -12 0 0 0 Tm (a) Tj ET Q") == pytest.approx([1.2])
    assert sizes("0 2 -2 0 0 0 cm BT /F1 6 Tf 1 0 0 1 5 5 Tm (a) Tj ET") == pytest.approx([12])
    assert binary.read("pdf", "x.pdf", pdf("0 0 0 0 0 0 cm BT /F1 6 Tf (a) Tj ET"))["paragraphs"][0]["runs"][0]["is_hidden"]

    body = b"BT /F1 9 Tf (words) Tj ET"
    for names, data in (
        ("/ASCII85Decode", base64.a85encode(body, wrapcol=10) + b"~>"), ("/ASCIIHexDecode", body.hex(" ").encode() + b">"),
        ("[/ASCII85Decode /FlateDecode]", base64.a85encode(zlib.compress(body)) + b"~>"),
    ):
        raw = pdf("@").replace(b"<< /Length 1 >>", f"<< /Filter {names} >>".encode()).replace(b"@", data)
        got = binary.read("pdf", "x.pdf", raw)
        assert got["error"] is None and got["paragraphs"][0]["text"] == "words", names
    for names, data in (("/LZWDecode", b"x"), ("/ASCII85Decode", b"vvvv~>"), ("/ASCIIHexDecode", b"zz>")):
        raw = pdf("@").replace(b"<< /Length 1 >>", f"<< /Filter {names} >>".encode()).replace(b"@", data)
        assert binary.read("pdf", "x.pdf", raw)["error"]["kind"] == "parse_failed"
