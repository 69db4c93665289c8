"""The warehouse and reconciliation suites against planted damage, and the shape of their plans."""

import re

import pytest
from pyspark.sql import functions as F

from lakeward.operators import suites
from lakeward.operators.publish import dim_countries
from lakeward.plans.pipeline import Pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def p(spark):
    return Pipeline(spark, SF, materialize=True)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan)), len(re.findall(r"(?:SortMergeJoin|HashJoin|NestedLoopJoin)", plan))


def test_suites_take_few_exchanges(spark, p):
    suite = suites.warehouse_validation(p.raw, p.classified, p.accepted, p.rejected, p.fact, p.dim_users, dim_countries(spark), p.mart)
    recon = suites.recon_violations(p.raw, p.classified, p.accepted, p.rejected, p.fact, p.mart)
    assert exchanges(suite)[0] <= 14 and exchanges(recon)[0] <= 8, (exchanges(suite), exchanges(recon))


def violations(p, **layers):
    frames = {"raw": p.raw, "classified": p.classified, "accepted": p.accepted, "rejected": p.rejected, "fact": p.fact, "mart": p.mart} | layers
    return {(r.test_name, r.batch_scope, r.metric): (r.observed, r.expected) for r in suites.recon_violations(**frames).collect()}


def test_lost_and_doubled_rows_are_named(p):
    batch = F.col("batch_id") == "b-20240105"
    n = p.accepted.where(batch).count()
    raw = p.raw.where(batch).count()
    clean = violations(p)
    assert not [k for k in clean if k[0] != "assert_source_anomaly_profile"]
    lost = violations(p, fact=p.fact.where(~F.coalesce(batch, F.lit(False))))
    assert lost["assert_batch_fact_reconciliation", "b-20240105", "fact_rows"] == (0, n)
    total = p.fact.count()
    assert lost["assert_mart_fact_reconciliation", None, "mart_event_total"] == (total, total - n)
    doubled = violations(p, rejected=p.rejected.unionByName(p.rejected.where(batch)))
    assert doubled["assert_fact_rejected_reconciliation", "b-20240105", "accepted_plus_rejected"] == (2 * raw - n, raw)
    short = violations(p, classified=p.classified.where(~F.coalesce(batch, F.lit(False))))
    assert short["assert_raw_classification_reconciliation", "b-20240105", "classification_rows"] == (0, raw)
    assert not [k for k in short if k[:2] == ("assert_source_anomaly_profile", "b-20240105")]


def test_orphans_and_null_countries_fail_the_global_checks(spark, p):
    def status(**damage):
        layers = {"fact": p.fact, "dim_users": p.dim_users, "mart": p.mart} | damage
        got = suites.warehouse_validation(p.raw, p.classified, p.accepted, p.rejected, layers["fact"], layers["dim_users"], dim_countries(spark), layers["mart"])
        rows = got.collect()
        return {r.check_name: (r.status, r.actual) for r in rows if r.batch_id is None}, {r.batch_id: r.status for r in rows if r.check_name == "overall"}

    good, overall = status()
    assert {s for s, _ in good.values()} == {"PASS"} and set(good) == {"fact_event_ids_unique", "fact_user_fk_resolves", "fact_country_fk_resolves", "mart_totals_reconcile"}
    assert "PASS" in overall.values()
    user = p.dim_users.first().user_id
    n = p.fact.where(F.col("user_id") == user).count()
    bad, overall = status(dim_users=p.dim_users.where(F.col("user_id") != user))
    assert bad["fact_user_fk_resolves"] == ("FAIL", n) and set(overall.values()) == {"FAIL"}
    bad, _ = status(fact=p.fact.withColumn("country_code", F.when(F.col("user_id") == user, F.lit(None)).otherwise(F.col("country_code"))))
    assert bad["fact_country_fk_resolves"] == ("FAIL", n)
    bad, _ = status(mart=p.mart.limit(1))
    assert bad["mart_totals_reconcile"][0] == "FAIL"
