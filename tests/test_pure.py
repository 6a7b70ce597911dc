"""Modules that need no Spark."""

import hashlib
import hmac

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgersift import masking, names, registry
from ledgersift.codes import SEVERITY, Code, FindingClass, Refusal, Verdict
from ledgersift.contract import METHOD_BUDGET, MethodResult, Signal, build, present
from ledgersift.identity import decode, encoded_columns
from ledgersift.operators.benford import RULES
from ledgersift.session import timeout_ms
from ledgersift.suitability import Rule, RuleSet, Threshold
from ledgersift.suite import plan, trim


@pytest.mark.parametrize("bad", ["", "a\0b", "100%", "x" * 64, "é" * 32])
def test_unsafe_names(bad):
    with pytest.raises(Refusal) as e:
        names.check_name(bad)
    assert e.value.code == Code.UNSAFE_IDENTIFIER


@pytest.mark.parametrize("good", ['o"dd', "with space", "select", "naïve", "x" * 63, "a`b"])
def test_awkward_names(good):
    assert names.check_name(good) == good
    assert names.ident(good)[1:-1].replace("``", "`") == good


def test_contract_rejects_raw_values():
    ok = MethodResult("completed", "m", dataset="v1", top=(Signal("abcdefghijkl", {"n": 1}, 0.5),))
    assert build(ok).total == 1
    for subject in ("ACME LTD", "12345"):
        with pytest.raises(Refusal) as e:
            build(MethodResult("completed", "m", dataset="v1", top=(Signal(subject),)))
        assert e.value.code == Code.RESULT_NOT_PRESENTABLE


def test_contract_needs_dataset_and_known_class():
    with pytest.raises(Refusal):
        build(MethodResult("completed", "m"))
    with pytest.raises(Refusal):
        build(MethodResult("completed", "m", dataset="v", finding_class="FRAUD"))
    assert build(MethodResult("completed", "m", dataset="v", finding_class=FindingClass.ANOMALY))


def test_contract_budget_trims_the_weakest():
    signals = tuple(Signal(f"group-{i}", {f"metric_{k}": 0.123456 for k in range(30)}, i / 10) for i in range(5))
    out = build(MethodResult("completed", "m", dataset="v", top=signals))
    assert len(present(out)) <= METHOD_BUDGET and out.top[0].subject == "group-4" and out.total == 5


def test_tokens_are_stable_and_one_for_all_spellings():
    key = b"k"
    t = masking.token("1234-5678 ab", key)
    assert t == masking.token("１２３４５６７８AB", key) and len(t) == 12 and t.isalpha()
    h = hmac.new(key, b"12345678AB", hashlib.sha256).hexdigest()[:12]
    assert t == h.translate(str.maketrans("0123456789", "ghijklmnop"))
    assert t != masking.token("1234-5678 ab", b"other")


def test_subjects_fail_closed():
    assert masking.subjects(["x"], None, False, False) == (["rank-1"], "withheld")
    assert masking.subjects(["x"], b"k", True, False)[1] == "masked"
    assert masking.subjects(["x"], b"k", True, True) == (["x"], "revealed")


def test_secret_is_made_once(tmp_path, monkeypatch):
    monkeypatch.delenv("FORENSIC_MASK_SALT", raising=False)
    assert masking.secret(tmp_path) == masking.secret(tmp_path)
    monkeypatch.setenv("FORENSIC_MASK_SALT", "s")
    assert masking.secret(tmp_path) == b"s"


def facts(**change):
    return {"nonzero": 300, "distinct": 100, "span": 2, "top10_share": 0.8, "nonpositive_share": 0.2, "is_key": False, "sensitive": False, "unique": False, "integer_share": 0.1, "words": ["amount"]} | change


@pytest.mark.parametrize(
    "change, verdict",
    [
        ({}, Verdict.SUPPORTED),
        ({"nonzero": 299}, Verdict.INSUFFICIENT_DATA),
        ({"distinct": 99}, Verdict.NOT_APPLICABLE),
        ({"span": 1.99}, Verdict.NOT_APPLICABLE),
        ({"top10_share": 0.81}, Verdict.NOT_APPLICABLE),
        ({"nonpositive_share": 0.21}, Verdict.SUPPORTED_WITH_WARNING),
        ({"is_key": True}, Verdict.NOT_APPLICABLE),
        ({"integer_share": 1, "unique": True}, Verdict.NOT_APPLICABLE),
        ({"integer_share": 1, "words": ["sno"]}, Verdict.NOT_APPLICABLE),
        ({"integer_share": 1, "words": ["page", "amount"]}, Verdict.SUPPORTED),
        ({"span": None}, Verdict.INSUFFICIENT_DATA),
        ({"nonzero": 299, "span": 1}, Verdict.INSUFFICIENT_DATA),
    ],
)
def test_benford_guard_boundaries(change, verdict):
    assert RULES.assess(facts(**change)).verdict == verdict


def test_rules_suppress_and_reject_cycles():
    always = lambda f: True
    a = Rule("A", Verdict.NOT_APPLICABLE, (), always)
    b = Rule("B", Verdict.UNSAFE_TO_RUN, (), always, unless=("A",), threshold=Threshold(1, "x"))
    got = RuleSet([b, a]).assess({})
    assert got.verdict == Verdict.NOT_APPLICABLE and got.unvalidated == ("B",)
    with pytest.raises(ValueError):
        RuleSet([Rule("A", Verdict.SUPPORTED, (), always, unless=("B",)), b])


def test_domain_inputs():
    rules = RuleSet([], inputs=["limit"])
    assert rules.assess({}).verdict == Verdict.INSUFFICIENT_DATA
    assert rules.assess({}, {"limit": False}).verdict == Verdict.REQUIRES_CONFIRMATION
    assert rules.assess({}, {"limit": True}).verdict == Verdict.SUPPORTED


def test_severity_order():
    assert SEVERITY[0] == Verdict.SUPPORTED and SEVERITY[-1] == Verdict.UNSAFE_TO_RUN


def test_registry_refuses_what_is_not_implemented():
    for name in (*registry.REGISTERED, "custom-test", "nothing"):
        with pytest.raises(Refusal) as e:
            registry.lookup(name)
        assert e.value.code == Code.NOT_IMPLEMENTED
    assert registry.describe("gap-sequence")["status"] == "registered"


@given(st.lists(st.text(min_size=1, max_size=10).filter(lambda s: "\0" not in s and "%" not in s and s.encode("utf-8", "ignore").decode() == s), min_size=2, max_size=4, unique=True))
def test_composite_keys_round_trip(columns):
    import json

    values = json.dumps([c[::-1] for c in columns])
    assert decode(encoded_columns(columns), values) == {c: c[::-1] for c in columns}


def test_timeouts(monkeypatch):
    monkeypatch.delenv("FORENSIC_STATEMENT_TIMEOUT_MS", raising=False)
    assert timeout_ms() == 60_000 and timeout_ms(0) == 0
    for bad in ("soon", -1):
        with pytest.raises(Refusal):
            timeout_ms(bad)


def test_suite_plan_and_trim():
    steps, skipped = plan(["a", "b"], "id", "name", True)
    assert [s["method"] for s in steps] == ["benford", "benford", "duplicate-analysis", "duplicate-analysis", "fuzzy-entity-match"]
    assert skipped == [{"method": "cross-dataset-match", "reason": "needs a second table"}]
    assert plan(["a"], None, None, False)[0] == []
    step = {"method": "m", "verdict": "SUPPORTED", "summary": "x" * 500, "top": [{"subject": "rank-1"}] * 5}
    reply = trim({"ran": [dict(step) for _ in range(20)], "declined": [], "refused": [], "errors": []})
    import json

    assert len(json.dumps(reply, separators=(",", ":"))) <= 6000 and all(s["verdict"] for s in reply["ran"])
