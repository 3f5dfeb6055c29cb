import glob
import json

import pytest
from samples import FILES, INVENTORY, N_LOCATIONS, SIMPLE_TEMPLATE

from varscope.operators import inventory as I
from varscope.operators import reconcile, reports, selection, template, verdict
from varscope.operators.extract import extract
from varscope.operators.ordering import with_ordinal
from varscope.session import materialize, scratch
from varscope.sources import sinks, tables
from varscope.streaming import alerts

SOURCE = "repo string, path string, content string"


@pytest.fixture(scope="module")
def corpus(spark, files_of):
    """The sample files as repo r, an unreadable file in r, and a repo without variables."""
    files = files_of(FILES).unionByName(
        spark.createDataFrame(
            [("r", 'x/lost "1".py', None), ("r", "lost.go", None), ("bare", "a.py", "x = 1"), ("bare", "a.txt", "")],
            SOURCE,
        )
    )
    refs = materialize(selection.walk_refs(files))
    found = materialize(I.inventory(refs))
    seen = selection.walked_paths(files)
    return files, refs, found, seen


def test_json_report_is_the_document(spark, corpus):
    files, refs, found, seen = corpus
    errors = I.scan_errors(selection.unreadable_paths(files))
    rows = reports.report_json(refs, found, I.scan_stats(seen, errors, found), errors)
    docs = {}
    for r in rows.orderBy("repo", *reports.ORDER).collect():
        docs.setdefault(r.repo, []).append(r.text)
    data = json.loads("\n".join(docs["r"]))
    # The layout is that of a standard two-space indented dump.
    assert "\n".join(docs["r"]) == json.dumps(data, indent=2, ensure_ascii=False)
    assert len(data["findings"]) == len(INVENTORY)
    assert sum(len(f["locations"]) for f in data["findings"]) == N_LOCATIONS
    assert data["findings"][1]["default_value"] is None
    assert data["findings"][3]["locations"] == [
        {"file": "Dockerfile", "line": 5, "column": 0, "snippet": "  ENV THEME='dark'"}
    ]
    assert data["scanned_files"] == 7
    assert data["errors"] == ["File not found: lost.go", 'File not found: x/lost "1".py']
    assert json.loads("\n".join(docs["bare"])) == {"findings": [], "scanned_files": 1, "errors": []}
    assert "\n".join(docs["bare"]) == json.dumps(json.loads("\n".join(docs["bare"])), indent=2)


def test_markdown_report(spark, corpus):
    files, refs, found, _ = corpus
    rows = reports.report_markdown(refs, found, files.select("repo").distinct())
    docs = {}
    for r in rows.orderBy("repo", *reports.ORDER).collect():
        docs[r.repo] = docs.get(r.repo, "") + r.text
    lines = docs["r"].split("\n")
    assert lines[0] == "| Name | Type | Required | Default | Locations |"
    assert "| REGION | STRING | yes |  | ledger.py:11<br>relay.go:6 |" in lines
    assert "| CACHE_PORT | PORT | yes | 6380 | Dockerfile:4<br>desk.ts:5 |" in lines
    assert len(lines) == len(INVENTORY) + 3 and lines[-1] == ""
    assert docs["bare"] == reports.MARKDOWN_HEAD


def test_verdict_json(spark, corpus):
    _, _, found, seen = corpus
    entries = template.parse_templates(
        spark.createDataFrame([("r", SIMPLE_TEMPLATE), ("bare", "OLD=1\n")], "repo string, content string")
    )
    merged = materialize(reconcile.reconcile(found, entries))
    checked = verdict.check(merged, I.scanned_files(seen))
    docs = {}
    for r in verdict.verdict_lines(merged, checked).orderBy("repo", "section", "pos").collect():
        docs.setdefault(r.repo, []).append(r.text)
    r, bare = (json.loads("\n".join(docs[repo])) for repo in ("r", "bare"))
    assert (r["status"], len(r["new_vars"]), r["stale_vars"], r["scanned_files"]) == ("fail", len(INVENTORY) - 3, ["LEGACY_FLAG"], 7)
    assert r["new_vars"][:2] == ["QUEUE_DSN", "CACHE_PORT"]
    assert bare == {"status": "pass", "new_vars": [], "stale_vars": ["OLD"], "scanned_files": 1}
    numbered = with_ordinal(
        merged.filter("status <> 'EXISTING'").select("repo", "status", "pos", "key"), ["repo", "status"], ["pos"]
    )
    drift = sorted(verdict.drift_outputs(numbered, checked).collect())
    assert [d.name for d in drift if (d.repo, d.list) == ("r", "new_vars")] == r["new_vars"]
    assert all(d.drift_detected for d in drift if d.repo == "r")
    assert [(d.list, d.name, d.drift_detected) for d in drift if d.repo == "bare"] == [("stale_vars", "OLD", False)]


def test_drift_has_a_row_per_name_at_every_size(spark):
    numbered = spark.range(2500).selectExpr("'r' as repo", "'NEW' as status", "id + 1 as ord", "'K' || id as key")
    checked = spark.createDataFrame([("r", 3, 2500), ("s", 1, 0)], "repo string, scanned_files long, n_new long")
    rows = verdict.drift_outputs(numbered, checked).orderBy("repo", "ord").collect()
    assert [(r.ord, r.name) for r in rows if r.repo == "r"] == [(i + 1, f"K{i}") for i in range(2500)]
    assert [tuple(r) for r in rows if r.repo == "s"] == [("s", None, None, None, 1, False)]


def test_markdown_file(spark, corpus, tmp_path):
    files, refs, found, _ = corpus
    pieces = materialize(reports.report_markdown(refs, found, files.select("repo").distinct()))
    sinks.write_documents(reports.whole_lines(pieces), str(tmp_path / "m"), ("section", "finding"))
    parts = sorted(glob.glob(str(tmp_path / "m" / "repo=r" / "part-*")))
    written = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert written == "".join(r.text for r in pieces.filter("repo = 'r'").orderBy(*reports.ORDER).collect())
    assert written.count("\n") == len(INVENTORY) + 2


def test_scratch_drops_its_tables(spark):
    with scratch(spark):
        outer = materialize(spark.range(3))
        with scratch(spark):
            inner = materialize(spark.range(4)).inputFiles()[0]
        assert not glob.glob(inner.removeprefix("file://")) and outer.count() == 3
        kept = outer.inputFiles()[0]
    assert not glob.glob(kept.removeprefix("file://"))


def test_sinks_round_trip(spark, corpus, tmp_path):
    _, _, found, _ = corpus
    sinks.write_table(found, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == len(INVENTORY)
    sinks.write_json(found, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).filter("default_value is null").count() == 7
    entries = template.parse_templates(
        spark.createDataFrame([("r", SIMPLE_TEMPLATE)], "repo string, content string")
    )
    blocks = reconcile.entry_lines(reconcile.reconcile(found, entries))
    sinks.write_documents(blocks, str(tmp_path / "d"), ("pos",))
    parts = sorted(glob.glob(str(tmp_path / "d" / "repo=r" / "part-*")))
    text = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert text.startswith(SIMPLE_TEMPLATE.split("LEGACY_FLAG")[0] + "# UNUSED")
    assert text.count("\n") == 3 + 2 + (len(INVENTORY) - 3) * 2


def test_sources_read_tables(spark, files_of, tmp_path):
    files_of({"b.py": "x", ".hid/_a.py": "y"}).write.parquet(str(tmp_path / "f"))
    files = tables.source_files(spark, str(tmp_path / "f"))
    assert [r.path for r in tables.walk_order(files).orderBy("parts").collect()] == [".hid/_a.py", "b.py"]


def test_check_changes(spark, files_of):
    files = (
        files_of({"a.py": 'os.getenv("A")', "node_modules/b.py": 'os.getenv("B")'}, "staged")
        .unionByName(files_of({"a.py": 'os.getenv("A")', "node_modules/b.py": 'os.getenv("B")'}, "full"))
        .unionByName(files_of({"a.py": 'os.getenv("A")'}, "gone"))
    )
    entries = template.parse_templates(
        spark.createDataFrame([(r, "A=1\n") for r in ("staged", "full")], "repo string, content string")
    )
    changes = spark.createDataFrame(
        [("staged", "node_modules/b.py", 1), ("gone", "deleted.py", 1)], "repo string, path string, ord bigint"
    )
    got = {r.repo: r.exit_code for r in verdict.check_changes(files, changes, entries).collect()}
    assert got == {"staged": 1, "full": 0, "gone": 0}


@pytest.mark.parametrize("watermark", [False, True])
def test_stream_reports_what_the_batch_finds(spark, files_of, tmp_path, watermark):
    source = str(tmp_path / "in")
    rows = [
        ("r", f"f{n}.py", f'os.getenv("V{n % 5}"); os.environ["DOC"]', "2024-01-01 00:00:00")
        for n in range(40)
    ]
    df = spark.createDataFrame(rows, SOURCE + ", ts string").selectExpr("repo", "path", "content", "to_timestamp(ts) as ts")
    df.repartition(4).write.parquet(source)
    entries = template.parse_templates(
        spark.createDataFrame([("r", "DOC=1\nV3=\n")], "repo string, content string")
    )
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = alerts.check_stream(stream, alerts.documented_names(entries), event_time="ts" if watermark else None)
    alerts.run_once(found, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.repo, r.name) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = reconcile.new(entries, I.inventory(extract(df)))
    assert got == sorted((r.repo, r.key) for r in batch.collect())
    assert got == [("r", f"V{n}") for n in (0, 1, 2, 4)]


def test_paths_are_selected_without_reading_text(spark, files_of, tmp_path):
    files_of({"a.py": "x", "b.py": None}).write.parquet(str(tmp_path / "f"))
    files = tables.source_files(spark, str(tmp_path / "f"))

    def scan(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return next(line for line in plan.split("\n") if "FileScan" in line)

    assert "content" not in scan(selection.walked_paths(files))
    lost = selection.unreadable_paths(files)
    assert "IsNull(content)" in scan(lost)
    assert [r.path for r in lost.collect()] == ["b.py"]
    # Aggregated facts need neither text nor a second scan.
    plan = reconcile.reconcile(
        I.inventory(extract(files)),
        template.parse_templates(spark.createDataFrame([("r", "A=1")], "repo string, content string")),
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
