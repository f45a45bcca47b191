"""Operators on small inputs with known results."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.operators import clones, complexity, dependencies, inventory, patches, relational, reports, rules, scores, service, tree
from auditspark.streaming import events as ev


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def test_split_lines(spark):
    for s in ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "\n", "x\x0by z"]:
        assert one(spark, text.split_lines(F.col("s")), s=s) == s.splitlines(), repr(s)


def test_normalize_line(spark):
    cases = {"  x = 1;  ": "x = 1", "# note": "", "a  \t b": "a b", "f()  # why": "f()", "url: 'http:#x'": "url: 'http:#x'", "go // there": "go", "* item": "", "": ""}
    for line, expected in cases.items():
        assert one(spark, text.normalize_line(F.col("s")), s=line) == expected, line


def test_match_lines(spark):
    code = "a\nfoo(1)\nb foo(2) foo(\n3)\n"
    assert one(spark, text.match_lines(F.col("s"), r"foo\([^)]*\)"), s=code) == [2, 3, 3]
    assert one(spark, text.match_lines(F.col("s"), r"bar"), s=code) == []


def test_versions(spark):
    triple = lambda s: one(spark, text.version_triple(F.col("s")), s=s)
    assert tuple(triple("^1.2.3")) == (1, 2, 3) and tuple(triple("v2")) == (2, 0, 0) and triple("latest") is None
    inside = lambda v, r: one(spark, text.version_in_range(text.version_triple(F.col("v")), F.col("r")), v=v, r=r)
    assert inside("2.6.0", "<2.20.0") and not inside("2.20.0", "<2.20.0") and inside("1.0", "==1.0.0") and not inside("1.0", "<1.3.0b3")


def test_secret_masking(spark):
    masked = one(spark, text.mask_secrets(F.col("s")), s="authorization: bearer abc.def gsk_" + "a" * 32)
    assert masked == "Authorization: Bearer ***[MASKED]*** gsk_***[MASKED]***"


@pytest.mark.parametrize(
    "path,skip,kind,test",
    [
        ("app/main.py", False, "source", False), ("rebuild.py", True, "source", False), ("a/inspector.py", False, "source", True), (".github/x.yml", True, "config", False),
        ("x/logo.PNG", True, "other", False), ("a.min.js", True, "source", False), ("tests/readme.md", False, "doc", False), ("Makefile", False, "other", False), (".env", False, "other", False),
    ],
)
def test_inventory(spark, path, skip, kind, test):
    p = F.col("p")
    assert one(spark, F.struct(inventory.should_skip(p), inventory.file_type(p), inventory.is_test(p)), p=path) == (skip, kind, test)


def test_patch_lines(spark):
    rows = spark.createDataFrame([(1, "@@ -1,3 +1,4 @@\n line1\n+line2 added\n-line3 removed\n line4"), (2, "")], "patch_id long, patch string")
    assert [tuple(r) for r in patches.added_lines(rows).collect()] == [(1, 2, "line2 added")]
    targets = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 9), (2, 1)], "patch_id long, target int")
    found = {(r[0], r[1]): r[2] for r in patches.diff_position(rows, targets).collect()}
    assert found == {(1, 1): 2, (1, 2): 3, (1, 3): 5, (1, 9): None, (2, 1): None}


def test_complexity():
    source = "def simple(x):\n    return x\nclass A:\n    def m(self, a, b):\n        if a and b:\n            for i in a:\n                with b:\n                    pass\n        elif b:\n            return [x for x in a if x]\n"
    assert complexity.functions_of(source) == [("simple", 1, 2, 1, 0), ("A.m", 4, 10, 7, 3)]
    assert complexity.functions_of("def (") == []


def test_requirements_and_packages(spark):
    rows = spark.createDataFrame([(1, "requests==2.6.0\nflask>=1.0\n# comment\n-r other.txt\npkg[extra]==1\n\nplain\n")], "manifest_id long, content string")
    found = [(r["name"], r["spec"], r["resolved"]) for r in dependencies.requirements(rows).orderBy("pos").collect()]
    assert found == [("requests", "==2.6.0", "2.6.0"), ("flask", ">=1.0", None), ("plain", "", None)]
    rows = spark.createDataFrame([(1, '{"dependencies": {"lodash": "^4.17.15", "odd": {"version": "1.0.0"}}}'), (2, "no json"), (3, None)], "manifest_id long, content string")
    found = [(r["name"], r["spec"], r["resolved"]) for r in dependencies.package_json(rows).collect()]
    assert found == [("lodash", "^4.17.15", "4.17.15")]


def test_classify(spark):
    own = spark.createDataFrame([(1, "pip", "requests", "2.6.0"), (2, "pip", "requests", "2.32.0"), (3, "pip", "other", "1.0.0"), (4, "npm", "lodash", None)], "id long, ecosystem string, name string, resolved string")
    adv = spark.createDataFrame([("pip", "requests", 1, "<2.20.0", "A-1", "High"), ("npm", "lodash", 1, "<5", "A-2", "High")], "ecosystem string, name string, ord int, range string, advisory string, advisory_severity string")
    latest = spark.createDataFrame([("pip", "other", 4)], "ecosystem string, name string, latest_major int")
    found = {r["id"]: (r["status"], r["advisory"]) for r in dependencies.classify(own, adv, latest).collect()}
    assert found == {1: ("known_vulnerable", "A-1"), 2: ("unknown", ""), 3: ("outdated", ""), 4: ("unknown", "")}


def test_clone_pair_runs(spark):
    body = [f"line {i}" for i in range(7)]
    rows = spark.createDataFrame([("r", 1, "\n".join(["one", *body, "end a"])), ("r", 2, "\n".join(["two", *body, "end b"])), ("other", 3, "\n".join(body)), ("r", 4, "a\nb")], "repo string, file_id long, content string")
    found = sorted((r["file_id_a"], r["file_id_b"], r["start_line_a"], r["duplicated_lines"]) for r in clones.clone_pairs(rows, 5).collect())
    assert found == [(1, 2, 2, 7), (1, 2, 3, 6), (1, 2, 4, 5)]


def test_scores(spark):
    values = dict(c=1, h=1, m=1, q=1)
    assert one(spark, scores.snapshot_security(F.col("c"), F.col("h"), F.col("m"), F.lit(0)), **values) == 54
    assert one(spark, scores.snapshot_quality(F.lit(0), F.lit(0), F.col("q")), **values) == 98
    assert one(spark, scores.risk(F.lit(5), F.col("h"), F.col("m"), F.lit(0)), **values) == 100
    gain = lambda a, b, low=True: one(spark, scores.improvement_pct(F.col("a"), F.col("b"), low), a=a, b=b)
    assert [gain(0, 0), gain(0, 3), gain(3, 2), gain(3, 4), gain(0, 3, False), gain(3, 4, False)] == [0, -100, 33, -33, 100, 33]


def test_trend(spark):
    rows = spark.createDataFrame([("a", 1, 1, 40, 8), ("a", 2, 2, 72, 4), ("b", 1, 3, 50, 1)], "repo string, at int, id int, health int, total int")
    found = {r["repo"]: r["trend_status"] for r in relational.trend(rows, "repo", "at", "id", ["health"], ["total"]).collect()}
    assert found == {"a": "improved", "b": None}


def test_lookaround_rules_as_in_python(spark):
    code = ["os.exec(a)", "exec (b)", "subprocess.exec(c)", "x.exec(d)", "set cookie token HttpOnly", "cookie = jwt", "child_process.exec(z)"]
    rows = spark.createDataFrame([(1, i, "p.py", c) for i, c in enumerate(code)], "repo long, file_id long, path string, content string")
    found = sorted((r["file_id"], r["issue"]) for r in rules.pattern_findings(rows, rules.LOOKING).collect())
    expected = sorted((i, r.issue) for i, c in enumerate(code) for r in rules.LOOKING if re.search(r.pattern, c))
    assert found == expected


def test_magic_numbers_as_in_python(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice(["x", "7", "42", " ", ".", "_", "=", "'", '"', "#", "A", "range(", "100", "3.5"]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(1, i, "p.py", 1, x) for i, x in enumerate(lines)], "repo long, file_id long, path string, line_no int, line string")
    found = {r["file_id"]: r["number"] for r in rules.magic_numbers(rows).collect()}
    expected = {}
    for i, line in enumerate(lines):
        s = line.strip()
        if s.startswith(("#", "//", "--", "*", "/*")) or re.search(r"range\s*\(", s):
            continue
        name = re.match(r"(\w+)\s*=", s)
        if name and name[1].upper() == name[1]:
            continue
        bare = re.sub(r"#[^#]*$", "", re.sub("'[^']*'", "''", re.sub('"[^"]*"', '""', s)))
        for m in re.finditer(r"(?<![A-Za-z_])(\d+\.?\d*)(?![A-Za-z_])", bare):
            if float(m[1]) not in (0, 1, 2, 10, 100) and float(m[1]) <= 10000:
                expected[i] = m[1]
                break
    assert found == expected


def test_rate_limit_batch_and_stream_as_a_plain_model(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(3), float(t), i, rng.random() < 0.1) for i, t in enumerate(sorted(rng.uniform(0, 300) for _ in range(300)))]
    events = spark.createDataFrame(rows, "key long, at double, event_id long, terminal boolean")
    allowed, written, kept, last = {}, {}, {}, {}
    for key, at, i, end in rows:
        kept[key] = [t for t in kept.get(key, []) if at - t < 60]
        if ok := len(kept[key]) < 4:
            kept[key].append(at)
        allowed[i] = ok
        if w := end or key not in last or at - last[key] >= 5:
            last[key] = at
        written[i] = w
    assert {r["event_id"]: r["admitted"] for r in ev.limited(events, 4, 60.0).collect()} == allowed
    assert {r["event_id"]: r["written"] for r in ev.throttled(events, 5.0).collect()} == written
    for part in range(3):  # three files, in time order
        events.where(F.floor(F.col("event_id") / 100) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, made, column, expected in (("limits", ev.limit_stream(source, 4, 60.0), "admitted", allowed), ("writes", ev.throttle_stream(source, 5.0), "written", written)):
        query = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert {r["event_id"]: r[column] for r in spark.table(name).collect()} == expected


def test_added_text_meets_all_rules(spark):
    code = "import json\nos.system(cmd)\npickle.loads(x)\nel.innerHTML = y\n@csrf_exempt\npassword = 'hunter2hunter2'\ndef f(a, b, c, d, e, g):\n    x = 37\n" + " " * 20 + "deep()\ncursor.execute('a' + b)\n@app.get('/x')\n"
    rows = spark.createDataFrame([(1, 1, "p.py", code), (1, 2, "q.py", "plain()\n")], "repo long, file_id long, path string, content string")
    found = rules.scan(rows).collect()
    assert {r["file_id"] for r in found} == {1}
    assert {"command_injection", "unsafe_deserialization", "xss", "csrf", "hardcoded_secrets", "sql_injection", "missing_authorization", "magic_number", "unused_import", "long_parameter_list", "deep_nesting"} <= {r["name"] for r in found}
    critical = sum(r["severity"] == "Critical" for r in found)
    assert [r["security_impact"] for r in rules.impact(rules.scan(rows)).collect()] == [f"{critical} critical security pattern(s) detected in the added code."]


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "README.md").write_text("# é")
    rows = {r["path"]: r for r in tree.read_tree(spark, f"file://{tmp_path}").collect()}
    assert {k: (r["size"], r["content"]) for k, r in rows.items()} == {"src/a.py": (6, "x = 1\n"), "README.md": (4, "# é")}
    assert {r["path"] for r in tree.read_tree(spark, str(tmp_path)).select("path").collect()} == set(rows)


def test_fetch_limits(spark):
    rows = [(1, "a.py", 300_000, "x"), (1, "b.py", 10, "1\n2\n3"), (1, "c.py", 5, " \n"), (1, "d.py", 20, "y"), (1, "build/e.py", 1, "z")]
    df = spark.createDataFrame(rows, "repo long, path string, size long, content string")
    assert [(r["path"], r["lines"]) for r in tree.fetched_sources(df, 1, most_lines=2).collect()] == [("b.py", ["1", "2"])]
    assert {r["path"] for r in tree.fetched_sources(df).collect()} == {"b.py", "d.py"}


def test_sinks(spark, tmp_path):
    """Routed and sorted findings, CSV with quotes, snapshots that are appended once, outputs that fail alone."""
    rows = [(1, "b.py", 2, "High", "security", 'say "x", y'), (1, "a.py", 9, "Low", "code_smell", "z"), (1, "a.py", 1, "Low", "security", "q"), (2, "c.py", 1, "Low", "style", "s")]
    df = spark.createDataFrame(rows, "analysis_id long, file string, line int, severity string, category string, issue string")
    reports.write_routed(df.coalesce(1), str(tmp_path / "routed"))
    assert [r["file"] for r in spark.read.parquet(str(tmp_path / "routed/security_findings")).collect()] == ["a.py", "b.py"]
    assert spark.read.parquet(str(tmp_path / "routed/code_smells")).count() == 1
    reports.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == list(reports.HEADER) and {r["Issue"] for r in back.collect()} == {'say "x", y', "z", "q", "s"}
    for _ in range(2):
        reports.append_snapshots(df.select("analysis_id").distinct(), str(tmp_path / "snap"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "snap")).collect()) == [1, 2]
    broken = df.select(F.raise_error(F.lit("no")).alias("x"))
    status = reports.run_isolated({"good": df, "bad": broken, "last": df}, str(tmp_path / "out"))
    assert status["good"] == status["last"] == "completed" and status["bad"].startswith("failed")


def test_duplicate_guard_batch_and_stream(spark, tmp_path):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(1, "c", start + datetime.timedelta(seconds=s), s) for s in (0, 30, 59, 61, 100, 130)] + [(2, "c", start, 7)]
    scans = spark.createDataFrame(rows, "repo long, commit string, ts timestamp, event_id long")
    assert sorted(r["event_id"] for r in ev.guard_duplicates(scans, 60.0).collect()) == [0, 7, 61, 130]
    scans.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(scans.schema).parquet(str(tmp_path / "in"))
    query = ev.guard_duplicates(source, 60.0).writeStream.format("memory").queryName("guard").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.table("guard").collect()) == [0, 7, 61, 130]


def test_heartbeat_stream(spark, tmp_path):
    import datetime
    import time

    start = datetime.datetime(2024, 1, 1)
    batches = [[(1, start, False), (2, start, False), (3, start, True)], [(2, start + datetime.timedelta(seconds=1), True), (4, start + datetime.timedelta(seconds=60), True)], [(4, start + datetime.timedelta(seconds=61), True)]]
    for rows in batches:
        spark.createDataFrame(rows, "key long, ts timestamp, terminal boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = spark.readStream.schema("key long, ts timestamp, terminal boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    query = ev.heartbeat_stream(source).writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["key"] for r in spark.table("beats").collect()} == {1}


def test_hmac(spark):
    import hashlib
    import hmac

    assert one(spark, service.hmac_sha256(F.col("s"), b"k1"), s="body é") == hmac.new(b"k1", "body é".encode(), hashlib.sha256).hexdigest()


def test_repository_names(spark):
    cases = {"https://github.com/a/b.git": "a/b", "git@github.com:a/b": "a/b", "a/b": "a/b", "x": None, "": None, "https://h.org/p/q/r": "q/r"}
    for url, name in cases.items():
        assert one(spark, service.repository_name(F.col("s")), s=url) == name, url


def test_rules_on_given_texts(spark):
    """The scan of the given documents finds what single rules find."""
    from auditspark.jobs import scans
    from auditspark.sources.adapters import files

    d = "/root/testdata/sf0.001"
    own = files(spark, d).select("repo", "file_id", "path", "content")
    found = scans.document_findings(spark, d).collect()
    secrets = {(r["file_id"], r["line"], r["issue"]) for r in rules.hardcoded_secrets(own).collect()}
    assert {(r["file_id"], r["line"], r["issue"]) for r in found if r["name"] == "hardcoded_secrets"} == secrets
    expected = set()
    for r in own.collect():
        for rule in rules.RULES:
            form = re.compile(rule.pattern)
            expected |= {(r["file_id"], r["content"][: m.start()].count("\n") + 1, rule.name) for m in form.finditer(r["content"])}
    names = {r.name for r in rules.RULES}
    assert {(r["file_id"], r["line"], r["name"]) for r in found if r["name"] in names and r["issue"] != rules.LOOKING[0].issue and r["issue"] != rules.LOOKING[1].issue} == expected


@pytest.mark.parametrize("code,ok,imports", [("import a.b\nx = 1", True, True), ("def f(:", False, True), ("", True, True)])
def test_python_check(code, ok, imports):
    assert service.python_check(code)[::2] == (ok, imports)
