"""Methods, case, runner and suite on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from ledgersift import functions as fx
from ledgersift import identity, registry, suite, version
from ledgersift.codes import Code, Refusal
from ledgersift.operators import benford, cross, duplicate, fuzzy, profile
from ledgersift.roles import Bindings, Role, suggest
from ledgersift.runner import run_test
from ledgersift.session import StatementTimeout, limited
from ledgersift.sources import Case, create_case, ingest, read_text_table, synthetic_pair, verify_store, with_row_numbers


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("case"))
    case = create_case(spark, root, {"source.pair": ["row_id"], "source.reg": ["row_id"], "source.other": ["row_id"], "source.twice": ["id"]})
    synthetic_pair(spark, 5000).write.parquet(case.source("pair"))
    rows = [(i, reg, name, "x") for i, (reg, name) in enumerate([("R-1", "ACME TRADING"), ("r1", "ACME TRADNG"), ("R2", "ALICE ROY"), ("R2", "ALICE RAY"), ("R3", "BOB"), (None, "C"), ("", "D")])]
    spark.createDataFrame(rows, "row_id long, reg string, name string, `odd name` string").write.parquet(case.source("reg"))
    spark.createDataFrame([(1, "R1"), (2, "R9")], "row_id long, k string").write.parquet(case.source("other"))
    spark.createDataFrame([(1,), (1,)], "id long").write.parquet(case.source("twice"))
    return case


@pytest.mark.parametrize("text, digit", [("0.0456", 4), ("-7.1", 7), ("0", None), ("0.0000001", 1), ("1000000000000", 1)])
def test_first_digit(spark, text, digit):
    assert one(spark.range(1).select(fx.first_digit(fx.number(F.lit(text))))) == digit


def test_digits_absent_are_zero(spark):
    rows = benford.digits(spark.createDataFrame([(1.0,), (15.0,), (0.0,), (None,)], "x double"), fx.number(F.col("x"))).collect()
    assert [(r.digit, r.n) for r in sorted(rows)] == [(1, 2)] + [(d, 0) for d in range(2, 10)]
    assert math.isclose(sum(r.expected for r in rows), 1)
    empty = benford.digits(spark.createDataFrame([], "x double"), fx.number(F.col("x")))
    assert empty.count() == 9 and one(empty.agg(F.sum("n"))) == 0


def test_seeded_pair(spark):
    df = synthetic_pair(spark)
    good, bad = (benford.summary(benford.digits(df, F.col(c))).first() for c in ("conforming", "fixed_band"))
    assert good.mad < 0.006 and good.band == "close" and bad.mad > 0.1 and bad.band == "nonconforming" and bad.p_value < 1e-6


def test_normalisation(spark):
    row = spark.range(1).select(fx.norm_key(F.lit("１２３４-5678 ab")), fx.norm_name(F.lit("  a  b-c ")), fx.norm_key(F.lit(" - "))).first()
    assert tuple(row) == ("12345678AB", "A B C", None)


def test_mask_token_is_hmac(spark):
    from ledgersift import masking

    assert one(spark.range(1).select(fx.mask_token(fx.norm_key(F.lit("ab-1")), b"secret"))) == masking.token("ab-1", b"secret")


def test_trigram_similarity(spark):
    pairs = lambda *n: fuzzy.similar_pairs(spark.createDataFrame([("", x) for x in n], "scope string, name string")).collect()
    assert pairs("ALICE ROY", "ALICE RAY") == []
    assert len(pairs("ACME TRADING", "ACME TRADNG", "ZEBRA")) == 1


def test_fuzzy_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("ABCDE") for _ in range(rng.randint(2, 9))) for _ in range(40)]
    names = sorted({b if rng.random() < 0.5 else b[:-1] + "X" for b in base for _ in range(2)})
    grams = {n: {("  " + n + " ")[i : i + 3] for i in range(len(n) + 1)} for n in names}
    want = {(a, b) for a in names for b in names if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.55}
    got = fuzzy.similar_pairs(spark.createDataFrame([("", n) for n in names], "scope string, name string")).select("a", "b").collect()
    assert {tuple(r) for r in got} == want


def test_duplicates_and_shared(spark, case):
    df = case.table("reg")
    assert {(r.key, r.n) for r in duplicate.duplicates(df, ["reg"]).collect()} == {("R1", 2), ("R2", 2)}
    assert duplicate.blanks(df, ["reg"]).first().blank == 2
    assert {r.key for r in duplicate.shared(df, "reg", "name").collect()} == {"R1", "R2"}
    assert {r.key for r in fuzzy.conflicts(df, "reg", "name").collect()} == {"R2"}


def test_cross(spark, case):
    row = cross.reconcile(case.table("reg"), ["reg"], case.table("other"), ["k"]).first()
    assert (row.left_keys, row.right_keys, row.matched, row.only_left, row.only_right) == (3, 2, 1, 2, 1)
    assert {r.key for r in cross.only_left(case.table("reg"), ["reg"], case.table("other"), ["k"]).collect()} == {"R2", "R3"}


def test_versions(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "id long, a string, x double")
    f = version.fingerprint(df)
    assert f == version.fingerprint(df.repartition(3).orderBy(F.desc("id")))
    assert f.startswith("s56:2:")
    for other in (df.withColumn("a", F.coalesce("a", F.lit(""))), df.limit(1), df.union(df), df.withColumn("x", F.col("x") + 1)):
        assert version.fingerprint(other) != f


def test_identity(spark, case):
    assert identity.resolve(case.table("reg"), ["row_id"]) == ["row_id"]
    numbered = spark.createDataFrame([(1, 5), (2, 5)], f"`{identity.ROW_NO}` long, x long")
    assert identity.resolve(numbered, None) == [identity.ROW_NO]
    for df, keys in ((case.table("twice"), ["id"]), (numbered.withColumn(identity.ROW_NO, F.lit(1)), None), (case.table("reg"), None)):
        with pytest.raises(Refusal) as e:
            identity.resolve(df, keys)
        assert e.value.code == Code.NO_ROW_IDENTITY


def test_profile_facts(spark):
    df = spark.createDataFrame([(float(i % 7), str(i), None) for i in range(70)], "x double, t string, n string")
    f = profile.facts_for(df, "x")
    assert (f["rows"], f["nulls"], f["nonzero"], f["distinct"], f["unique"], f["integer_share"]) == (70, 0, 60, 7, False, 1.0)
    assert f["nonpositive_share"] == pytest.approx(1 / 7) and f["top10_share"] == 1
    assert profile.facts_for(df, "t")["unique"] is True
    assert profile.facts_for(df, "n")["null_rate"] == 1
    wide = spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(130)])
    assert len(profile.scan(wide)) == 130
    assert not profile.size_gate(spark.range(11), 10) and profile.size_gate(spark.range(11), 10, allow=True)


def test_pattern_shares(spark):
    df = spark.createDataFrame([("ABCDE1234F",), ("9876543210",), ("a@b.co",), ("1234 5678 9012",), ("SBIN0001234",)], "v string")
    assert {r.pattern: r.matches for r in profile.pattern_shares(df, "v").collect()} == {"aadhaar": 1, "pan": 1, "ifsc": 1, "mobile": 1, "email": 1}


def test_roles(spark):
    df = spark.createDataFrame([(i, f"V{i % 5}", 10.5 * i, f"{9876500000 + i}") for i in range(1, 50)], "invoice_no long, vendor_name string, amount double, phone string")
    found = {(s.role, s.column) for s in suggest(profile.scan(df))}
    assert (Role.AMOUNT, "amount") in found and (Role.IDENTIFIER, "invoice_no") in found and (Role.ENTITY_NAME, "vendor_name") in found
    assert not any(c == "phone" for _, c in found) and (Role.AMOUNT, "invoice_no") not in found
    bound = Bindings(df)
    with pytest.raises(Refusal):
        bound.confirm(Role.AMOUNT, "amount", " ")
    with pytest.raises(Refusal):
        bound.facts_for(Role.AMOUNT)
    bound.confirm(Role.AMOUNT, "amount", "Kim")
    assert bound.facts_for(Role.AMOUNT)["rows"] == 49


def test_runner_benford(spark, case, tmp_path):
    assert run_test(case, "benford", "pair", column="conforming").verdict == "REQUIRES_CONFIRMATION"
    good = run_test(case, "benford", "pair", column="conforming", confirmed_by="Kim", salt_folder=str(tmp_path))
    assert (good.status, str(good.finding_class), good.verdict) == ("completed", "OBSERVATION", "SUPPORTED")
    bad = run_test(case, "benford", "pair", column="fixed_band", confirmed_by="Kim")
    assert bad.status == "declined" and "NARROW_RANGE" in bad.why
    forced = run_test(case, "benford", "pair", column="fixed_band", confirmed_by="Kim", allow_unsuitable=True)
    assert str(forced.finding_class) == "OBSERVATION" and "no claim" in forced.summary
    assert good.dataset == forced.dataset and case.evidence.read("datasets").where("`table` = 'source.pair'").count() == 1


def test_runner_records_links_and_masks(spark, case, tmp_path):
    r = run_test(case, "duplicate-analysis", "reg", identifier="reg", salt_folder=str(tmp_path))
    assert r.status == "completed" and r.evidence["links"] == 4 and r.values == "masked" and r.total == 2
    assert "R1" not in json.dumps(r.as_dict()["top"])
    links = case.evidence.read("evidence_links").where(F.col("finding_id") == r.finding_ids[0])
    assert {x.key_value for x in links.collect()} == {"0", "1", "2", "3"}
    assert case.evidence.findings().where(F.col("finding_id") == r.finding_ids[0]).count() == 1
    case.evidence.review(r.finding_ids[0], "Kim", "explained")
    assert case.evidence.findings().where("reviewer_state = 'explained'").count() == 1
    x = run_test(case, "cross-dataset-match", "reg", identifier="reg", right_table="other", right_column="k", salt_folder=str(tmp_path))
    assert x.status == "completed" and x.evidence["links"] == 4


@pytest.mark.parametrize(
    "args, code",
    [
        ({"method": "outlier", "table": "reg"}, Code.NOT_IMPLEMENTED),
        ({"method": "duplicate-analysis", "table": "none", "identifier": "reg"}, Code.NO_SUCH_TABLE),
        ({"method": "duplicate-analysis", "table": "reg", "identifier": "gone"}, Code.NO_SUCH_COLUMN),
        ({"method": "duplicate-analysis", "table": "reg"}, Code.MISSING_ARGUMENT),
        ({"method": "duplicate-analysis", "table": "a%b", "identifier": "reg"}, Code.UNSAFE_IDENTIFIER),
        ({"method": "duplicate-analysis", "table": "twice", "identifier": "id"}, Code.NO_ROW_IDENTITY),
        ({"method": "benford", "table": "reg", "column": "name", "confirmed_by": "Kim"}, Code.WRONG_COLUMN_TYPE),
        ({"method": "duplicate-analysis", "table": "reg", "identifier": "reg", "statement_timeout_ms": "x"}, Code.BAD_CONFIGURATION),
    ],
)
def test_runner_refuses(case, args, code):
    r = run_test(case, **args)
    assert (r.status, r.code) == ("refused", str(code))


def test_no_identity_registers_no_dataset(case):
    run_test(case, "duplicate-analysis", "twice", identifier="id")
    assert case.evidence.read("datasets").where("`table` = 'source.twice'").isEmpty()


def test_custom_method(case):
    registry.register_custom("short-names", lambda df, name: df.where(F.length(name) < 4), ("name",), "Toy.")
    r = run_test(case, "custom:short-names", "reg", name="name")
    assert r.status == "completed" and r.total == 3 and r.evidence["links"] == 3
    registry.register_custom("broken", lambda df, name: 1 / 0, ("name",), "Toy.")
    assert run_test(case, "custom:broken", "reg", name="name").code == str(Code.TEST_ERROR)


def test_suite(case, tmp_path):
    asks = suite.run_suite(case, "pair")
    assert asks["status"] == "needs_confirmation"
    out = suite.run_suite(case, "reg", identifier="reg", entity_name="name", amount="name", confirmed_by="Kim", salt_folder=str(tmp_path))
    assert [s["method"] for s in out["ran"]] == ["duplicate-analysis", "duplicate-analysis", "fuzzy-entity-match"]
    assert [s["code"] for s in out["refused"]] == ["WRONG_COLUMN_TYPE"]
    assert suite.run_suite(case, "pair", amount="conforming", confirmed_by="Kim", size_limit=10)["verdict"] == "UNSAFE_TO_RUN"
    assert suite.run_suite(case, "none")["status"] == "refused"


def test_timeout_cancels(spark):
    slow = spark.range(0, 200_000, 1, 8).crossJoin(spark.range(1_000_000).withColumnRenamed("id", "b")).where("hash(id, b) = 1 AND hash(b, id) = 2")
    with pytest.raises(StatementTimeout), limited(spark, 800):
        slow.count()
    assert spark.range(5).count() == 5


def test_store_only_appends(case):
    assert verify_store(case) == {"tables": True, "append_only": True, "locked": False}


def test_no_case_is_refused(spark, monkeypatch):
    monkeypatch.delenv("FORENSIC_CASE_ROOT", raising=False)
    with pytest.raises(Refusal):
        Case(spark, None)


def test_ingest(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('code,"odd, name",when\n007,,2020-01-01\n1e5,"a ""q""",\n', encoding="utf-8")
    case = create_case(spark, str(tmp_path / "c"))
    manifest = ingest(case, str(path), "t")
    rows = sorted(case.table("t").collect(), key=lambda r: r["_row_no"])
    assert [tuple(r) for r in rows] == [("007", None, "2020-01-01", 1), ("1e5", 'a "q"', None, 2)]
    assert manifest["rows"] == 2 and manifest["fingerprint"].startswith("s56:2:")
    assert all(t == "string" for _, t in read_text_table(spark, str(path)).dtypes)


def test_row_numbers(spark):
    df = with_row_numbers(spark.range(1000).repartition(7), ["id"])
    assert [r["_row_no"] for r in df.orderBy("id").collect()] == list(range(1, 1001))


def test_awkward_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "`select` long, `o``dd c` string")
    assert duplicate.duplicates(df, ["o`dd c"]).first().n == 2
    assert profile.facts_for(df, "o`dd c")["rows"] == 2
