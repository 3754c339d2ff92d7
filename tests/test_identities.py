
import pytest

from helpers import metrics
from subrecon import operators as ops
from subrecon.functions.values import SUB_KEYS


@pytest.fixture(scope="module")
def rec(fixture_rec):
    return fixture_rec()


def test_flag_no_equals_anti_join(rec):
    """Flag NO in response_flagged = substitutions without a response key
    (holds because no matched response has a null status here)."""
    flagged_no = rec.response_flagged.where("response_record = 'NO'").count()
    anti = rec.ev.substitution_events.join(rec.responses.select(*SUB_KEYS), list(SUB_KEYS), "left_anti")
    assert flagged_no == anti.count() == 1744


def test_responses_split_into_semi_and_anti(rec):
    r, s = rec.responses, rec.ev.substitution_events.select(*SUB_KEYS)
    semi = r.join(s, list(SUB_KEYS), "left_semi").count()
    anti = ops.responses_without_substitution(rec.ev.substitution_events, r).count()
    assert semi + anti == r.count()


def test_flag_rows_add_up(rec):
    cov = {row["response_record"]: row["count"] for row in rec.response_coverage().collect()}
    assert cov["YES"] + cov["NO"] == rec.response_flagged.count()
    s = metrics(rec.reconciliation_summary())
    # without fan-out this is matched + unmatched = substitutions (published: 1,345,041 + 715,769);
    # the stand-ins have 8 rows of fan-out (FIXTURES.md section 4, T4)
    assert s["matched_responses"][0] + cov["NO"] == rec.response_flagged.count()
    assert rec.response_flagged.count() - s["substitutions"][0] == 8


def test_contradiction_split_adds_up(rec):
    m = metrics(rec.contradiction_matrix())
    assert m["accept_vs_rejected"][0] + m["reject_vs_accepted"][0] == m["contradictions"][0]
    assert m["accept_vs_rejected"][2] + m["reject_vs_accepted"][2] == pytest.approx(100.0)
    parts = sum(m[k][0] for k in ("contradictions", "accept_vs_accepted", "reject_vs_rejected", "other"))
    assert parts == m["contradictions"][1]


def test_recovered_at_most_unanswered(rec):
    r = metrics(rec.recovery_rate())["recovered_from_clicks"]
    assert 0 <= r[0] <= r[1]


def test_semi_at_most_inner(rec):
    for report in (rec.contradiction_register_check(), rec.unanswered_register_rate()):
        m = metrics(report)
        inner = next(v for k, v in m.items() if k.endswith("_inner"))
        semi = next(v for k, v in m.items() if k.endswith("_semi"))
        total = next(v for k, v in m.items() if v[1] is None)
        assert semi[0] <= inner[0] and semi[0] <= total[0]
