"""Policy files, whole and broken."""

import json

import pytest
from pyspark.sql import functions as F

from turnwright.operators import reporting
from turnwright.sources.files import read_turns
from turnwright.sources.policies import read_tenants, read_thresholds

GATES = {"classes": {"date": {"classifier_min": 0.9, "asr_min": 1, "require_lex_cue": True, "defer_on_partial": False}}, "streaming": {"partial_stable_min": 2, "partial_safe_classes": ["money"]}}
TENANTS = {
    "defaults": {"tenant": "in", "date_order": "MDY"}, "tenants": {"us": {"region": "US", "currency": "USD"}, "in": {"region": "IN", "date_order": "DMY"}, "bare": None},
    "locales": {"hi": {"currency_cues": {"accept": ["Rs", "₹"], "canonical": "₹"}}, "hi-IN": {"inherits": "hi"}},
}


def put(tmp_path, data, name="p.json"):
    (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data))
    return str(tmp_path / name)


def test_whole_files(spark, tmp_path):
    gates = read_thresholds(spark, put(tmp_path, GATES))
    assert (gates.classes, gates.stable_at, gates.partial_safe) == ({"date": (0.9, 1.0, True, False)}, 2, ("money",))
    own = read_tenants(spark, put(tmp_path, TENANTS))
    assert own.rows == (("default", "IN", "DMY", "INR"), ("us", "US", "MDY", "USD"), ("in", "IN", "DMY", "INR"), ("bare", "", "MDY", "INR"))
    assert own.default == "in" and own.cues == {"hi": (("Rs", "₹"), "₹", ())}
    rows = spark.createDataFrame([("us",), ("nobody",), (None,), ("in",)], "t string")
    got = reporting.with_tenant(rows, "t", own.rows).select(F.coalesce("t", F.lit("")), "date_order").collect()
    assert {tuple(r) for r in got} == {("us", "MDY"), ("nobody", "DMY"), ("", "DMY"), ("in", "DMY")}


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    assert read_tenants(spark, put(tmp_path, "tenants:\n  default: {region: IN}\n", "p.yaml")).rows == (("default", "IN", "DMY", "INR"),)
    with pytest.raises(ValueError, match="line 3"):
        read_tenants(spark, put(tmp_path, "tenants:\n  a: [1\nb: 2\n", "q.yaml"))


@pytest.mark.parametrize(("read", "data", "says"), [
    (read_thresholds, GATES | {"classes": {"date": {"classifier_min": 1.5, "asr_min": 1, "require_lex_cue": True, "defer_on_partial": False}}}, "from 0 to 1"),
    (read_thresholds, GATES | {"classes": {"date": {"classifier_min": 1, "asr_min": 1, "require_lex_cue": "no", "defer_on_partial": False}}}, "true or false"),
    (read_thresholds, GATES | {"streaming": {}}, "are needed"), (read_thresholds, {}, "are needed"), (read_thresholds, GATES | {"classes": [1]}, "must be a table"),
    (read_tenants, {"tenants": {"a": {}}}, "'default' is not among"), (read_tenants, TENANTS | {"tenants": {"in": {"date_order": "YDM"}}}, "unsupported date_order 'YDM'"),
    (read_tenants, TENANTS | {"tenants": {"in": {}, "default": {}}}, "must be the default"), (read_tenants, TENANTS | {"locales": {"hi": {"currency_cues": {"accept": [], "canonical": "₹"}}}}, "needs `accept`"),
    (read_tenants, "[]", "a table of settings"), (read_tenants, " " * (1 << 20) + "{}", "one file of at most"),
])
def test_broken_files(spark, tmp_path, read, data, says):
    with pytest.raises(ValueError, match=says):
        read(spark, put(tmp_path, data))


def test_turns_of_files(spark, tmp_path):
    put(tmp_path, "SPEAKER a 1 5.0 2.0 <NA> <NA> s1 <NA> <NA>\nSPEAKER a 1 0.0 3.0 <NA> <NA> s2 <NA>\n;; note\nSPEAKER a 1 2.5 1.0 <NA> <NA> s1\nSPEAKER a 1\n", "a.rttm")
    put(tmp_path, "SPEAKER b 1 2.0 9.0 <NA> <NA> s9\n", "b.rttm")
    put(tmp_path, "", "c.rttm")
    got = sorted((r.path[-6:], r.place, r.speaker, r.start_sec, r.overlap_flag) for r in read_turns(spark, str(tmp_path / "*.rttm")).collect())
    assert got == [("a.rttm", 0, "s2", 0.0, True), ("a.rttm", 1, "s1", 2.5, True), ("a.rttm", 2, "s1", 5.0, False), ("b.rttm", 0, "s9", 2.0, False)]
