"""Operators that SQL cannot express, against plain brute force over whole tables or small fixtures."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lakeward.llm import html_main, packing, queries, secrets, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_pack_against_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer_path())
    want = {}
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[d.doc_id, k] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    got = queries.op2_pack(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 1


def test_chunks_tokenize_as_whole_texts_do():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer_path()
    whole, chunked = Tokenizer.from_file(path), packing.ChunkTokenizer(path, memo=5)
    rng = np.random.default_rng(3)
    alphabet = list("abIt's ,.!\t\n\r\x0b\x0c\x1c ́é中9<|endoftext|># ")
    for _ in range(200):
        text = "".join(rng.choice(alphabet, 40)) + "<|endoftext|> x<|startoftext|>"
        want = whole.encode(text, add_special_tokens=False).ids
        ids, ends = chunked.encode(pa.array(["", text, "A. a, é. İ. ﬁ, '."]))
        assert ids[ends[1] : ends[2]].tolist() == want and ends[1] == 0
        assert ids[ends[2] :].tolist() == whole.encode("A. a, é. İ. ﬁ, '.", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    counts[1:] = rng.integers(0, 9, 64) * (rng.random(64) < (0.2, 0.6, 1)[seed % 3])
    used = np.zeros(65, np.int64)
    made = packing.plan(counts, 64)
    for times, parts in made:
        assert sum(n * k for n, k in parts) <= 64 and times > 0
        for n, k in parts:
            used[n] += times * k
    assert (used == counts).all()


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashed = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def classes(fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_against_all_pairs(spark, docs):
    rows = sorted((d.doc_id, d.text or "") for d in docs)
    fps = [fingerprint(t) for _, t in rows]
    want = {i: (f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, classes(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, SF).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("m,tree", [(1, 4096), (1, 8), (2, 4096), (3, 16)])
def test_links_in_dense_clusters(spark, m, tree):
    rng = np.random.default_rng(m * 31 + tree)
    fps = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2**63)) * 2
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in flips))
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    shard = {1: 2048, 2: 1, 3: 0}[m]
    n = len(fps) if m == 1 else 2**22 if m == 2 else 2**27
    assert simhash.blocks_kept(n, 4, shard if m == 1 else 4) == m
    pairs = simhash.links(df, n, shard=shard if m == 1 else 4, tree=tree)
    from lakeward.llm.common import components

    found = {r.node: r.root for r in components(pairs, "t").collect()}
    got = [found.get(f, f) for f in fps]
    want = classes([f & (2**64 - 1) for f in fps])
    by = {}
    for g, w in zip(got, want, strict=True):
        by.setdefault(w, set()).add(g)
    assert all(len(x) == 1 for x in by.values()) and len({*got}) == len({*want})


def test_secrets_against_plain_scans(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_secrets(spark, sf).collect()}
    hits = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text, base, every = d.text or "", [], []
        for k, rule in enumerate(secrets.RULES):
            for x in re.finditer(rule.pattern, text, re.ASCII):
                if len(x.group(rule.group)) >= rule.least:
                    every.append((x.start(), k, f"{rule.kind}:{x.start()}:{x.end()}"))
                    base += [every[-1]] * (k < 3)
        joined = ",".join(s for *_, s in sorted(base))
        r = got[d.doc_id]
        assert r.spans == ",".join(s for *_, s in sorted(every))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        hits += len(base)
    assert hits


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] == () and q["access"] == (frozenset([frozenset(["aki", "kia"])]),)
    assert frozenset(["tok", "oke", "ken"]) in q["assign"][0] and len(q["assign"][0]) == 6
    assert all("://" in grams for grams in q["url_login"][0])
    assert q["github"] == (frozenset(frozenset([f"gh{c}", f"h{c}_"]) for c in "pousr"),)


def test_secrets_of_each_further_kind(spark):
    text = {
        "private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "a1" * 18, "slack": "xoxb-0123456789-ab",
        "google": "AIza" + "x" * 35, "stripe": "sk_live_" + "9" * 16, "jwt": f"eyJ{'a' * 12}.eyJ{'b' * 12}.c_-",
        "url_login": "postgres://me:pass@",
    }
    rows = [(i, f"é {t} .") for i, t in enumerate(text.values())]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r, (kind, t) in zip(sorted(got, key=lambda r: r._id), text.items(), strict=True):
        assert (kind, 2, 2 + len(t)) in {(s.kind, s.start, s.end) for s in r.spans}


def test_long_logins_and_whole_keys(spark):
    key = "-----BEGIN EC PRIVATE KEY-----\nMHcCAQEE\nabc=\n-----END EC PRIVATE KEY-----"
    login = f"https://{'u' * 300}:{'p' * 900}@"
    texts = [("url_login", login, "host/"), ("private_key", key, "\nafter"), ("private_key", key[:40], ""), ("private_key", key[:30], "\n" + key)]
    rows = [(i, f"é {t}{rest}") for i, (_, t, rest) in enumerate(texts)]
    got = {r._id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = [[(s.start, s.end) for s in got[i] if s.kind == kind] for i, (kind, _, _) in enumerate(texts)]
    assert own == [[(2, 2 + len(login))], [(2, 2 + len(key))], [(2, 32)], [(2, 32), (33, 33 + len(key))]]


def article(page):
    """By the markup of these pages: what stands between the article's tags, block by block."""
    import html

    own = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", own)
    text = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(t for t in text if t)


def test_main_text_of_whole_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op5_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


PAGE = """<html><head><title>T one two</title></head><body><header class="top"><h1>Site name</h1></header>
<div id="main-menu"><ul><li><a href=/>Home</a><li><a href=/x>News items</a></ul></div>
<div class="cookie-notice"><p>We use cookies, please accept all of them now.</p></div>
<div class="content"><h2>Real  title</h2><p>First &lt;para&gt; of the<br>article &amp; more words here.
<p>Second <em>para</em>graph with enough words to count.<div class="ad-box"><p>Buy this now for little money!</div>
<blockquote>A quote of some words.</blockquote></div><aside><p>Related things to read elsewhere today.</p></aside>
<form><label>Mail</label><input name=m></form><div class="comments"><p>I disagree with all of this text.</p></div>
<footer>&copy; 2020 Site</footer><script>if (a < b) { "<p>not text</p>" }</script></body></html>"""


@pytest.mark.parametrize("learned", [False, True])
def test_main_text_of_another_layout(spark, learned):
    weights = html_main.fit(spark.read.parquet(f"{SF}/pages.parquet")) if learned else html_main.Weights(html_main.Counter())
    want = "Real title\nFirst <para> of the article & more words here.\nSecond paragraph with enough words to count.\nA quote of some words."
    assert html_main.main_text(PAGE, weights) == want
    assert html_main.main_text("", weights) == html_main.main_text("<nav><a>x</a></nav>", weights) == ""


def lm_tokens(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or "")) + [None]


def test_lm_base_and_gain(spark):
    import math
    from collections import Counter

    from lakeward.llm import maxent_lm

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.collect()
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    n = Counter(t for r in learned for t in lm_tokens(r.text))
    total = sum(n.values())
    got = {r._id: r for r in maxent_lm.score(df, frequent=2000).collect()}
    for r in rows:
        tokens, g = lm_tokens(r.text), got[r.doc_id]
        base = sum(math.log10((n[t] + 1) / (total + len(n) + 1)) for t in tokens)
        assert g.base_score == pytest.approx(base, abs=1e-6) and g.score < 0
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(tokens), sum(n[t] > 0 for t in tokens), total)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_lm_sums_to_one(spark):
    """Over one history, the words of every class and its unknown word have probability one together."""
    from lakeward.llm import maxent_lm as lm

    words = spark.createDataFrame([(f"w{i}", i % 7 + 1) for i in range(200)], "word string, n long")
    v = lm._vocabulary(words, 5, 300)
    rng = np.random.default_rng(1)
    z = lm._log_softmax(rng.normal(size=(64, lm.CLASSES)).astype(np.float32), np.array([[3, 9, 60]]))[0]
    _, classes, log_n, known = v.look_up([f"w{i}" for i in range(200)])
    assert known.all()
    total = sum(np.exp(z[c]) * 10 ** (g - v.log_total[c]) for c, g in zip(classes, log_n, strict=True))
    total += np.exp(z[0]) * 10 ** (np.log10(6) - v.log_total[0])
    total += sum(np.exp(z[c]) / 10 ** v.log_total[c] for c in range(lm.CLASSES))
    assert total == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("rows", [1 << 10, 1 << 16, 1 << 18])
def test_lm_histories_reach_every_row(rows):
    from lakeward.llm import maxent_lm as lm

    token = np.r_[np.arange(200_000), -1]
    got = lm._history(token, np.array([0, len(token)]), np.arange(200_000, dtype=np.uint64) * np.uint64(2654435761), rows)
    assert got.max() < rows and len(np.unique(got >> max(0, rows.bit_length() - 11))) == 1 << 10


def test_lm_learns_an_order(spark):
    """Held-out texts in the learned word order score above the same words shuffled."""
    from lakeward.llm import maxent_lm

    rng = np.random.default_rng(5)
    cycle = "red green blue one two three up down left right".split()

    def text(k):
        at = int(rng.integers(10))
        return " ".join(cycle[(at + i) % 10] for i in range(40 + k % 5))

    rows = [(i, text(i)) for i in range(600)]
    mixed = [(10_000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows if zlib.crc32(str(10_000 + i).encode()) % 7 == 2]
    got = maxent_lm.score(spark.createDataFrame(rows + mixed, "doc_id long, text string")).collect()
    right = [r.score / r.n_tokens for r in got if r.held_out and r._id < 10_000]
    wrong = [r.score / r.n_tokens for r in got if r._id >= 10_000]
    assert wrong and np.mean(right) > np.mean(wrong) + 0.3


def test_toxicity_on_held_out_labels(spark):
    from lakeward.llm import toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).join(labels, toxicity.F.col("_id") == labels.doc_id).where("held_out").collect()
    score, y = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    assert ((score >= 0) & (score <= 1)).all() and all(r.predicted == (r.score >= 0.5) for r in got)
    wins = (score[y == 1][:, None] > score[y == 0]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0]).mean()
    assert wins > 0.93 and (score[y == 0] >= 0.5).mean() < 0.03
    print("auc", wins, "clean flagged", (score[y == 0] >= 0.5).mean(), "caught", (score[y == 1] >= 0.5).mean())
