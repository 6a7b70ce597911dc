"""The command line, workbooks, limits and failures of a run."""

import json
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgersift import __main__ as cli
from ledgersift import runner, suite
from ledgersift.codes import Code, FindingClass, Refusal
from ledgersift.operators import cross, duplicate, profile
from ledgersift.session import StatementTimeout, limited
from ledgersift.sources import create_case, ingest, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_book(path):
    """A workbook of two sheets: shared and inline texts, a date, a boolean, gaps, a blank row."""
    cells = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>paid on</t></is></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c></row>'
        '<row r="2"><c r="A2" t="inlineStr"><is><t>007</t></is></c><c r="B2"><v>1.50</v></c><c r="C2" s="1"><v>45000</v></c><c r="D2" t="b"><v>1</v></c></row>'
        '<row r="3"/><row r="4"><c r="A4" t="s"><v>2</v></c><c r="D4" t="inlineStr"><is><t> </t></is></c></row>'
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>code</t></si><si><t>amount</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{cells}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    write_book(tmp_path / "b.xlsx")
    want = [["code", "amount", "paid on", "ok"], ["007", "1.50", "2023-03-15", "TRUE"], [], ["ab", None, None, None]]
    assert list(workbook.rows((tmp_path / "b.xlsx").read_bytes())) == want
    case = create_case(spark, str(tmp_path / "case"))
    manifest = ingest(case, str(tmp_path / "b.xlsx"), "book")
    assert manifest["rows"] == 2 and manifest["columns"] == want[0] and manifest["fingerprint"].startswith("s56:2:")
    rows = case.table("book").orderBy("_row_no").collect()
    assert [tuple(r) for r in rows] == [(*want[1], 1), (*want[3], 2)]
    assert ingest(case, str(tmp_path / "b.xlsx"), "two", sheet="Two")["rows"] == 0
    with pytest.raises(Refusal):
        ingest(case, str(tmp_path / "b.xlsx"), "none", sheet="None")


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "case")

    def run(*argv):
        return cli.execute(vars(cli.parser().parse_args(argv)), spark)

    (tmp_path / "t.csv").write_text("code,amount\n" + "".join(f"c{i % 900},{1.017 ** i:.4f}\n" for i in range(1000)))
    assert run("create-case", "--case", root) == {"status": "completed", "case": root, "keys": 0}
    assert run("ingest", "--case", root, "--source", str(tmp_path / "t.csv"), "--table", "t")["rows"] == 1000
    assert run("run-test", "--case", root, "benford", "--table", "t", "--column", "amount")["verdict"] == "REQUIRES_CONFIRMATION"
    out = run("run-test", "--case", root, "benford", "--table", "t", "--column", "amount", "--confirmed-by", "R. Singh")
    assert out["status"] == "completed" and out["scanned"] == 1000
    out = run("run-test", "--case", root, "duplicate-analysis", "--table", "t", "--identifier", "code")
    assert out["evidence"]["links"] == 200 and len(json.dumps(out)) < 2000
    assert run("run-test", "--case", root, "benford", "--table", "nope", "--column", "x", "--confirmed-by", "a")["code"] == "NO_SUCH_TABLE"
    assert run("run-suite", "--case", root, "--table", "t")["status"] == "needs_confirmation"
    assert run("verify", "--case", root)["append_only"]
    assert cli.main(["describe-method", "benford@1.1.0"]) == 0 and cli.main(["describe-method", "nothing"]) == 1
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 2 and json.loads(lines[0])["method"] == "benford" and json.loads(lines[1])["status"] == "refused"


@pytest.fixture
def case(spark, tmp_path):
    case = create_case(spark, str(tmp_path / "case"), {"source.a": ["id"], "source.b": ["id"]})
    spark.createDataFrame([(1, "K1", 5.0), (2, "K2", 1.0), (3, "K3", 2.0)], "id long, k string, x double").write.parquet(case.source("a"))
    spark.createDataFrame([(7, "K1", 5.0), (8, "K2", 1.5), (9, "K9", 2.0)], "id long, k string, y double").write.parquet(case.source("b"))
    return case


def test_links_of_both_sides(case):
    out = runner.run_test(case, "cross-dataset-match", "a", identifier="k", right_table="b", right_column="k", amount="x", right_amount="y")
    links = {(r.key_column, r.key_value) for r in case.evidence.read("evidence_links").collect()}
    assert out.status == "completed" and out.evidence["links"] == 4
    assert links == {("id", "2"), ("id", "3"), ("source.b:id", "8"), ("source.b:id", "9")}


def test_links_that_fail_are_recorded(case, monkeypatch):
    def broken(c):
        bad = c.df.withColumn("id", F.raise_error(F.lit("links")).cast("long"))
        return runner.Outcome(FindingClass.ANOMALY, "x", 3, {}, flagged=bad)

    spec = runner.registry.MethodSpec("broken", "1", "implemented", "x", (), broken)
    monkeypatch.setitem(runner.registry._specs, "broken", spec)
    out = runner.run_test(case, "broken", "a")
    assert out.status == "error" and out.code == Code.TEST_ERROR
    events = [r.event for r in case.evidence.read("audit_log").orderBy("at").collect()]
    assert events == ["started", "failed"] and case.evidence.findings().count() == 0


def test_a_limit_holds_between_jobs(spark):
    """The timer fires while no job runs; the next job is cancelled all the same, and so is a normal end."""
    with pytest.raises(StatementTimeout), limited(spark, 200):
        spark.range(10).count()
        time.sleep(0.6)
        spark.range(1 << 40).selectExpr("sum(id * rand())").collect()
    with pytest.raises(StatementTimeout), limited(spark, 100):
        time.sleep(0.4)
    with limited(spark, 5000):
        assert spark.range(10).count() == 10
    assert threading.active_count() < 50


def test_gate_of_the_profiler(spark, case):
    df = case.table("a")
    with pytest.raises(Refusal) as e:
        profile.scan(df, limit=2)
    assert e.value.code == Code.TABLE_TOO_LARGE and profile.scan(df, limit=2, allow_large=True)["x"]["rows"] == 3
    out = runner.run_test(case, "benford", "a", column="x", confirmed_by="R. Singh", size_limit=2)
    assert (out.status, out.verdict) == ("declined", "UNSAFE_TO_RUN")
    assert not profile.size_gate(spark.range(2_000_001)) and profile.size_gate(spark.range(2_000_000))
    assert suite.run_suite(case, "a", size_limit=2)["verdict"] == "UNSAFE_TO_RUN"


def test_profile_in_batches(spark):
    """More columns than one scan takes."""
    df = spark.range(10).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(130)])
    got = profile.scan(df)
    assert len(got) == 130 and got["c0"]["nonzero"] == 0 and got["c129"]["nonzero"] == 9
    rows = {r.column: r for r in profile.profile_table(df, [f"c{i}" for i in range(5)]).collect()}
    assert [rows[f"c{i}"].distinct for i in range(5)] == [1, 2, 3, 4, 5]


def test_typed_keys(spark):
    """Whole numbers keep their sign; nulls in a key leave the row out; text is normalised."""
    rows = [(1, 1, "a-1"), (-1, 1, "A1"), (1, 1, "b"), (None, 1, "B "), (1, None, ""), (-1, 1, None)]
    df = spark.createDataFrame(rows, "x long, y int, t string")
    assert {tuple(r) for r in duplicate.duplicates(df, ["x", "y"]).collect()} == {('["1","1"]', 2), ('["-1","1"]', 2)}
    assert {tuple(r) for r in duplicate.duplicates(df, ["t"]).collect()} == {("A1", 2), ("B", 2)}
    assert {tuple(r) for r in duplicate.duplicates(df, ["x", "t"]).collect()} == set()
    found = duplicate.flagged_rows(df, ["x", "y"], duplicate.duplicates(df, ["x", "y"]))
    assert sorted(r.flag for r in found.collect()) == ['["-1","1"]'] * 2 + ['["1","1"]'] * 2
    assert duplicate.flagged_rows(df, ["x"], duplicate.duplicates(df, ["x"])).count() == 5
    assert {r.key for r in cross.unmatched(df, ["x"], spark.range(2).toDF("x"), ["x"]).collect()} == {"-1"}


def test_reply_stays_within_its_budget():
    reply = {"status": "completed", "table": "t", "ran": [{"method": "benford", "column": f"c{i}", "verdict": "SUPPORTED", "run": "r" * 12, "summary": "s" * 300, "top": [{"a": 1}] * 5, "evidence": {"k": "v" * 50}} for i in range(40)], "declined": [], "refused": [], "errors": [], "skipped": []}
    out = suite.trim(reply)
    assert len(json.dumps(out, separators=(",", ":"))) <= suite.SUITE_BUDGET and [x["column"] for x in out["ran"]] == [f"c{i}" for i in range(40)]
    with pytest.raises(Refusal):
        suite.trim(reply, 500)
