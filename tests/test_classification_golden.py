"""Golden classification fixtures (given staged rows -> expected reasons/ranks)."""

import datetime as dt

from pyspark.sql import functions as F

from lakeward.operators.classify import classify_events
from lakeward.operators.staging import stage_events
from lakeward.schemas import RAW_EVENTS


def raw_row(event_id, user_id="user-1", ts="2026-07-14 10:00:00", event_date="2026-07-14", country="US",
            ingested="2026-07-14 12:00:00", source_file="f/a.jsonl", run="run-1", batch=None, processing_date=None):
    p = lambda s: dt.datetime.fromisoformat(s)
    d = lambda s: dt.date.fromisoformat(s) if s else None
    return (event_id, user_id, "login", p(ts), d(event_date), country, "web", "1.0.0", p(ingested), source_file, run,
            batch, d(processing_date))


def classify(spark, rows):
    raw = spark.createDataFrame(rows, RAW_EVENTS)
    out = classify_events(stage_events(raw), hot_event_ids=None)
    return {(r.event_id, r.source_file): r for r in out.collect()}


def test_missing_user_beats_invalid_country(spark):
    got = classify(spark, [raw_row("evt-1", user_id=None, country="ZZ")])
    r = got[("evt-1", "f/a.jsonl")]
    assert r.rejection_reason == "missing_user_id" and r.is_accepted is False


def test_invalid_country_beats_future(spark):
    got = classify(spark, [raw_row("evt-2", country="ZZ", ts="2026-07-15 10:00:00", event_date="2026-07-15")])
    r = got[("evt-2", "f/a.jsonl")]
    assert r.is_future_dated and r.rejection_reason == "invalid_country_code"


def test_latest_write_wins_within_batch(spark):
    got = classify(spark, [
        raw_row("evt-dup", ts="2026-07-14 09:00:00", ingested="2026-07-14 11:00:00", source_file="old"),
        raw_row("evt-dup", ts="2026-07-14 10:00:00", ingested="2026-07-14 12:00:00", source_file="new"),
    ])
    assert got[("evt-dup", "new")].duplicate_rank == 1 and got[("evt-dup", "new")].rejection_reason == "accepted"
    old = got[("evt-dup", "old")]
    assert old.duplicate_rank == 2 and old.rejection_reason == "duplicate_extra" and old.duplicate_scope == "within_batch"


def test_warning_flags_do_not_reject(spark):
    got = classify(spark, [raw_row("evt-warn", event_date="2026-07-09")])
    r = got[("evt-warn", "f/a.jsonl")]
    assert r.is_backdated_event_date and r.has_event_date_timestamp_mismatch and r.rejection_reason == "accepted"


def test_future_dated_blocks(spark):
    got = classify(spark, [raw_row("evt-f", ts="2026-07-16 10:00:00", event_date="2026-07-16")])
    assert got[("evt-f", "f/a.jsonl")].rejection_reason == "future_dated"


def test_cross_batch_replay_first_seen_wins(spark):
    got = classify(spark, [
        raw_row("evt-r", ingested="2026-07-14 06:00:00", batch="batch-a", source_file="a", processing_date="2026-07-14"),
        raw_row("evt-r", ingested="2026-07-14 15:00:00", batch="batch-b", source_file="b", processing_date="2026-07-14"),
    ])
    assert got[("evt-r", "a")].rejection_reason == "accepted"
    b = got[("evt-r", "b")]
    assert b.rejection_reason == "duplicate_extra" and b.duplicate_scope == "cross_batch_replay"
    assert b.within_batch_duplicate_rank == 1


def test_rejected_rank_one_still_outranks_sibling(spark):
    """The later row (rank 1) has no user: it is missing_user_id and its valid
    sibling is duplicate_extra, so the id is not accepted at all."""
    got = classify(spark, [
        raw_row("evt-t", user_id=None, ingested="2026-07-14 13:00:00", source_file="late"),
        raw_row("evt-t", ingested="2026-07-14 12:00:00", source_file="early"),
    ])
    assert got[("evt-t", "late")].rejection_reason == "missing_user_id"
    assert got[("evt-t", "early")].rejection_reason == "duplicate_extra"
    assert not any(r.is_accepted for r in got.values())


def test_blank_user_is_missing_after_staging(spark):
    got = classify(spark, [raw_row("evt-b", user_id="   ", country=" us ")])
    r = got[("evt-b", "f/a.jsonl")]
    assert r.user_id is None and r.country_code == "US" and r.rejection_reason == "missing_user_id"
