"""What the trees learn from rules, and that a rule's verdict does not leak through a suffix."""

import random

import pytest
from pyspark.sql import functions as F

from evledger.llm import url_filter
from evledger.session import materialize

RULES = [
    url_filter.Rule("block", "spam.net/"), url_filter.Rule("block", "junk.org/"), url_filter.Rule("block", "trash.com/x/"),
    url_filter.Rule("allow", "good.com/"), url_filter.Rule("allow", "fine.net/"), url_filter.Rule("allow", "well.org/"),
]


def url(rng, host, bad):
    if bad:
        path = "/".join(str(rng.randrange(10**8)) for _ in range(rng.randint(2, 4)))
        return f"http://{host}/x/{path}?" + "&".join(f"q{k}={rng.randrange(10**6)}" for k in range(rng.randint(2, 5)))
    return f"https://{host}/" + "/".join(rng.choice(["news", "about", "garden", "tea"]) for _ in range(rng.randint(1, 2)))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    rows = []
    for rule in RULES:
        rows += [(len(rows) + k, url(rng, rule.host, rule.verdict == "block"), None) for k in range(60)]
    for k in range(200):
        bad = rng.random() < 0.5
        rows.append((1000 + k, url(rng, rng.choice(["one.net", "two.org", "three.com", "four.info"]), bad), int(bad)))
    return materialize(spark.createDataFrame(rows, "page_id long, url string, bad int"), "pages")


def test_verdicts_follow_the_text_of_the_url(pages):
    """Held-out URLs on other hosts are judged as the labelled ones teach."""
    rows = url_filter.judge(pages, RULES).join(pages, "page_id").filter("bad IS NOT NULL").collect()
    assert len(rows) == 200
    right = sum((r["verdict"] == "block") == bool(r["bad"]) for r in rows)
    assert right >= 195
    assert all((r["verdict"] == "block") == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("left", range(len(RULES)))
def test_a_rule_left_out_is_learned_from_the_others(pages, left):
    """AUC over the URLs of each rule in turn against those of the opposite verdict."""
    kept = [r for k, r in enumerate(RULES) if k != left]
    rows = url_filter.judge(pages, kept).filter("score IS NOT NULL").join(pages.drop("url"), "page_id").collect()
    own = [r["score"] for r in rows if r["bad"] is None]
    other = [r["score"] for r in rows if r["bad"] is not None and bool(r["bad"]) != (RULES[left].verdict == "block")]
    sign = 1 if RULES[left].verdict == "block" else -1
    auc = sum((sign * a > sign * b) + (a == b) / 2 for a in own for b in other) / (len(own) * len(other))
    assert len(own) == 60 and auc > 0.95


def test_rates_come_from_other_rules(pages):
    """A suffix of one rule tells nothing; a labelled row does not see its own rule."""
    rules = [url_filter.Rule("block", "spam.net/"), url_filter.Rule("allow", "fine.net/"), url_filter.Rule("block", "junk.org/")]
    host, path = url_filter.host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = url_filter.features(url_filter.apply_rules(rows, rules)).withColumn("label", (F.col("ruled") == "block").cast("double"))
    rows = materialize(rows, "rows")
    labelled, rest = rows.filter("label IS NOT NULL"), rows.filter("label IS NULL")
    overall = 120 / 180
    open_ = {r["host_suffix"]: (r["host_suffix_rate"], r["host_suffix_share"]) for r in url_filter._with_rates(rest, labelled, False).collect()}
    assert open_["org"] == open_["com"] == open_["info"] == (pytest.approx(overall), 0.0)
    prior = url_filter.PRIOR
    assert open_["net"] == (pytest.approx((60 + prior * overall) / (120 + prior)), pytest.approx(120 / 180))
    own = {r["host"]: r["host_suffix_rate"] for r in url_filter._with_rates(labelled, labelled, True).collect()}
    assert own["spam.net"] == pytest.approx(prior * overall / (60 + prior))
    assert own["fine.net"] == pytest.approx((60 + prior * overall) / (60 + prior))
    assert own["junk.org"] == pytest.approx(overall)
    assert url_filter._with_rates(rows, labelled, False).count() == rows.count()
