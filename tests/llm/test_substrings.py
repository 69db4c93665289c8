"""Repeated substrings against a plain dictionary of all windows."""

import hashlib

import numpy as np
import pytest

from lakeward.llm import queries
from lakeward.llm import substring_dedup as sd

SF = "/root/testdata/sf0.001"


def brute(rows, n=100):
    """Per (id, text): bytes, removed, spans, hash of the rest; rows in order."""
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - n + 1):
            w = data[at : at + n]
            if w in seen:
                gone[at : at + n] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out[i, text] = (len(data), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = {k[0]: v for k, v in brute(rows).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_substrings(spark, SF).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000


@pytest.mark.parametrize("hot", [1, 3, sd.HOT])
def test_passages_periods_and_copies(spark, hot):
    rng = np.random.default_rng(hot)
    word = lambda n: "".join(rng.choice(list("abcdeé "), n))
    passage, other = word(160), word(99)
    rows = [(i, word(int(rng.integers(0, 90))) + passage[: int(rng.integers(90, 161))] + word(40)) for i in range(30)]
    rows += [(40, "ab" * 300), (41, "x" * 99), (42, "x" * 150), (43, "ba" * 120 + other), (44, other + passage), (45, None), (46, "")]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, "é" * 70), (53, "é" * 80 + "x" * 120), (54, word(400) * 2)]
    rows.append((None, rows[5][1]))
    df = spark.createDataFrame(rows + [rows[2], rows[35], rows[-1]], "doc_id long, text string").repartition(5)
    want = {k[0]: v for k, v in brute(rows).items()}
    got = {r._id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.remove_repeats(df, hot).collect()}
    assert got == want


def test_every_period_in_a_document_of_its_own(spark):
    rng = np.random.default_rng(69)
    rows = [(1000 * times + period, "".join(rng.choice(list("abcdefgh \n"), period)) * times) for period in range(1, 141) for times in range(2, 7)]
    rows.sort()
    want = {k[0]: v for k, v in brute(rows).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r._id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.remove_repeats(df).collect()}
    assert got == want and all(want[1000 * times + 69][1] for times in range(3, 7))
