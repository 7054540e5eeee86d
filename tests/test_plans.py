"""Plan-shape regressions for the scale properties found by measuring:
the extraction appears once per plan, and filters on extracted fields are not
pushed below the extraction."""

import pytest

SF = "/root/testdata/sf0.001"


def plan_of(df):
    """The plan that ran: with adaptive execution, that of the last stages."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["drift_report", "def_diff", "table_status", "distinct_versions"])
def test_extraction_runs_once(spark, name):
    import __spark_entry__ as entry
    plan = plan_of(entry.queries()[name](spark, SF))
    assert plan.count("AS _body_full") == 1, name


def test_filter_stays_above_extraction(spark):
    import __spark_entry__ as entry
    plan = plan_of(entry.queries()["x_clustered"](spark, SF))
    # the IS NOT NULL filter sits on the generator output, not inside the regex chain
    assert "Generate inline" in plan
    filters = [ln for ln in plan.splitlines() if "Filter" in ln and "clustered" in ln]
    assert filters and all("regexp" not in ln for ln in filters)


@pytest.mark.parametrize("name", ["def_diff", "change_report", "drift_report", "change_flags"])
def test_diff_shares_one_exchange_without_string_aggregation(spark, name):
    import __spark_entry__ as entry
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "SortAggregate" not in plan and plan.count("AS _body_full") == 1
    # no table has more than one run of versions here: the spread of the texts
    # before extraction and the exchange by run are all that is left
    assert plan.count("Exchange hashpartitioning") <= 5


def test_interval_branches_share_one_extraction(spark):
    import __spark_entry__ as entry
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # reuse shows in the static plan
    try:
        plan = plan_of(entry.queries()["version_intervals"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedExchange" in plan and plan.count("AS _body_full") == 1


def test_nothing_runs_while_intervals_are_planned(spark, corpus_of):
    from schemaloom.operators import extract, history
    defs = extract.definitions(corpus_of([("t", 1, "CREATE TABLE d.t (a INT)")]))
    spark.sparkContext.setJobGroup("planning", "")
    df = history.version_intervals(defs)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    assert [(r.v, r.valid_to) for r in df.collect()] == [(1, None)]


def test_status_extracts_two_versions_of_a_table_at_most(spark, corpus_of, monkeypatch):
    from schemaloom.operators import extract, history
    seen = []
    monkeypatch.setattr(history, "definitions",
                        lambda c: seen.append(c.count()) or extract.definitions(c))
    corpus = corpus_of([("t", v, f"CREATE TABLE d.t (c{v} INT)") for v in range(1, 9)]
                       + [("u", 1, "CREATE TABLE d.u (a INT)"), ("w", 1, "CREATE TABLE d.w (a ((")])
    keys = corpus.select("db", "tbl", "v")
    got = history.classify_runs(corpus, keys.where("v < 7 and tbl <> 'w'"), keys.where("tbl <> 'u'"))
    assert {r.tbl: r.status for r in got.collect()} == {"t": "changed", "u": "deleted", "w": "new"}
    assert seen == [4]
