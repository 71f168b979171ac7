import pytest

from sparkveil.operators import policy, scoring
from sparkveil.sources import captures


@pytest.mark.parametrize("mode,counts,leak,alarms", [("shield", (49, 0, 6), 5.8, 0), ("fortress", (52, 1, 3), 3.8, 1)])
def test_detection_scores(spark, mode, counts, leak, alarms):
    truth = captures.truth(spark)
    found = captures.predictions(policy.sanitize(captures.regions(spark), mode)).checkpoint()
    matched = scoring.match(truth.filter("must_redact"), found).checkpoint()
    s = scoring.score_all(truth, found, matched).head()
    assert (s.tp, s.fp, s.fn) == counts and round(100 * s.leak_rate, 1) == leak and s.false_alarms == alarms
    lost = sorted(r.cls for r in scoring.leaks(truth, matched).collect())
    assert lost == (["ADDRESS", "DOB", "EMAIL"] if mode == "shield" else ["ADDRESS", "EMAIL"])
