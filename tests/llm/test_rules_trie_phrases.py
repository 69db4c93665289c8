"""The rule ensemble, the prefix trie and phrase mining against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeward.llm import phrases, prefix_trie, rule_ensemble
from lakeward.sources.tables import read_table

SF = "/root/testdata/sf0.01"


# phrases


def plain_phrases(rows, threshold, longest=5, percent=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if a >= threshold}
        inner = Counter()
        for p, a in found.items():
            for m in range(1, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(inner[p[i : i + m]], a)
        for p, a in found.items():
            if len(p) > 1 and not (p in inner and 100 * inner[p] >= percent * a):
                score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                out.add((lang, " ".join(p), a, left, right, n[lang], score))
    return out


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "İx", "A", "a", "x\x00y"]
    rows = []
    for k in range(150):
        words = [vocabulary[min(int(rng.expovariate(0.4)), 16)] for _ in range(rng.randrange(0, 40))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " , "]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), rng.choice([text, text, text, text.upper(), None if k % 10 == 0 else text])))
    late = "rare pair of words here"  # only in the last rows: reached late in the cycle
    return rows + [("en", late)] * 9 + [("fr", "one two one two one two one")] * 2 + [("de", "")]


@pytest.mark.parametrize("shards,chunk", [(1, 1 << 20), (3, 300), (4, 1)])
def test_phrases_match_plain_counting(spark, monkeypatch, shards, chunk):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "n", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(2)
    got = phrases.collocations(docs, threshold=4, shards=shards, chunk=chunk)
    want = plain_phrases(rows, 4)
    assert {tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()} == want
    assert any(len(p.split()) == 5 for _, p, *_ in want)


def test_a_full_bitmap_changes_no_count(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(phrases, "LEAST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "HELD", 10)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(docs, threshold=4, shards=3, chunk=500)
    assert {tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()} == plain_phrases(rows, 4)


def test_inside_percent_and_ranking(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string")
    loose = phrases.collocations(docs, threshold=4, inside_percent=60)
    assert {tuple(r) for r in loose.select("lang", "phrase", "a", "l", "r", "n", "score").collect()} == plain_phrases(rows, 4, percent=60)
    top = phrases.ranked(loose, 3).collect()
    for lang in {r.lang for r in top}:
        own = sorted((r for r in plain_phrases(rows, 4, percent=60) if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:3]
        assert [r.phrase for r in sorted((r for r in top if r.lang == lang), key=lambda r: r.rank)] == [r[1] for r in own]


def test_equal_hashes_are_told_apart():
    codes = np.array([1, 2, 1, 2, 3, 2], np.int32)
    at, n = phrases._distinct(codes, np.array([0, 2, 4]), 2, np.zeros(3, np.uint64))
    assert sorted(zip([tuple(codes[a : a + 2]) for a in at], n, strict=True)) == [((1, 2), 2), ((3, 2), 1)]


# trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len([x for x in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if x]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += children[p] == 0
    return Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 130), 1000, 1001, 10**12 + 7]:
        if c == 40:
            continue  # a family without its first conversation
        for k in range(rng.choice([1, 2, 2, 3, 5, 9, 17])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(["hello you", "", None, "a b c", "x\ty z  w"])))
    rows += [(7, 3, "user", "again")] * 4  # repeated rows
    rows += [(200 + i, k, "user", f"turn {k}") for i in range(3) for k in range(45 - i)]  # long, and one a prefix of another
    rows += [(300 + i, k, "user", "the same") for i in range(25) for k in range(4)]
    return rows + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("block,part", [(8, 20_000), (2, 3), (1, 1)])
def test_trie_matches_plain_walk(spark, monkeypatch, block, part):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, k1 string, depth int").repartition(3)
    monkeypatch.setattr(prefix_trie, "PART", part)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = Counter(tuple(r[c] for c in cols) for r in prefix_trie.trie(df, block=block).collect())
    assert got == plain_trie(rows)


def test_ids_of_one_node_pass_one_hash_in_parts(spark):
    ends = spark.range(1000).selectExpr("cast(1 as decimal(38,0)) as k1", "cast(2 as decimal(38,0)) as k2", "id as conv_id").repartition(5)
    (row,) = prefix_trie.ends_digest(ends, part=7).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()


def test_all_conversations_without_turns(spark):
    (free,) = [[c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1][:5]]
    rows = [(c, 0, "user", "lost") for c in free]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r[c] for c in cols) for r in prefix_trie.trie(df).collect()) == plain_trie(rows)


# rules


def plain_statistics(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    share = lambda a, b: a / b if b else 0.0
    chars = sum(map(len, words))
    return [
        len(words), share(chars, len(words)), share(sum(c in "#*$%&|<>{}=~^_\\" for c in t), len(t)), share(sum(c in "!?" for c in t), len(t)),
        share(sum(c.isupper() for c in t), chars), share(sum(c in "0123456789" for c in t), chars),
        share(sum(not any(c.isalpha() or c in "0123456789" for c in w) for w in words), len(words)), share(len(words), len(lines)),
        share(sum(bool(re.search(r"[.!?:;\"'”»)][\x20\x09-\x0D]*$", x)) for x in lines), len(lines)), share(len(set(lines)), len(lines)),
        share(len(set(words)), len(words)), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)), share(len(set(grams)), len(grams)),
    ]


def test_statistics_match_plain_counting(spark):
    docs = read_table(spark, SF, "documents").limit(120)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t "), (-4, "ÄÖ ** A1 A1\n\nÄÖ! \n1 2 3 4 1 2 3 4")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd)
    rows = rule_ensemble.statistics(docs, F.col("doc_id"), F.col("text")).collect()
    for r in rows:
        assert [r[c] for c in rule_ensemble.STATISTICS] == pytest.approx(plain_statistics(r.text)), r.doc_id


@pytest.fixture(scope="module")
def known(spark):
    docs, labels = (read_table(spark, SF, t) for t in ("documents", "labels"))
    return docs, labels, rule_ensemble.learn(docs, labels)


def test_compiled_rules_equal_the_matrix(known):
    docs, _, model = known
    rows = rule_ensemble.statistics(docs, F.col("doc_id")).withColumn("score", model.column()).collect()
    x = np.array([[r[c] for c in rule_ensemble.STATISTICS] for r in rows])
    assert model.probability(x) == pytest.approx(np.array([r.score for r in rows]), abs=1e-9)
    assert 0 < len(model.rules) < 150 and len(model.describe()) == len(model.rules)


def test_held_out_quality(known):
    docs, labels, _ = known
    got = {r["_id"]: r for r in rule_ensemble.classify(docs, labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert {r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items()} == {True}
    good, bad = [r for r, y in held if y == 1], [r for r, y in held if y == 0]
    assert np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in bad]) < 0.25
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_and_other_columns_are_no_input(spark, known):
    docs, labels, model = known
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "n_words": F.lit("clash"), "_id": F.lit(1)})
    assert rule_ensemble.learn(other, turned) == model


def test_sample_is_bounded_and_repeats_are_settled(spark, known):
    docs, labels, model = known
    assert rule_ensemble.learn(docs.union(docs).repartition(5), labels.union(labels)) == model
    small = rule_ensemble.learn(docs, labels, per_class=40)
    assert small.rules


def test_lasso_against_its_optimality_conditions():
    rng = np.random.default_rng(0)
    a = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * a[:, 0] - 1.5 * a[:, 1])))).astype(float)
    w, c = rule_ensemble.lasso(a, y, 0.02, 4000)
    g = a.T @ (1 / (1 + np.exp(-(a @ w + c))) - y) / 400
    assert np.all(np.abs(g[w == 0]) <= 0.02 + 1e-4) and g[w != 0] == pytest.approx(-0.02 * np.sign(w[w != 0]), abs=1e-3)
    assert 0 < (w != 0).sum() < 12


@pytest.mark.parametrize("y,score", [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_one_class_or_none(spark, y, score):
    docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, q, 0) for i, q in zip(ids, y, strict=False)], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in rule_ensemble.classify(docs, labels).collect()} == {score}


# toxicity, beside its held-out accuracy


def test_toxicity_scores_against_plain_loops(spark):
    import zstandard

    from lakeward.llm import toxicity

    docs, labels = (read_table(spark, SF, t) for t in ("documents", "labels"))
    sample = sorted(toxicity.sample(docs, labels))
    model = toxicity.train(sample)

    def size(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(dict_data=d, level=12, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(c.compress(window))

    got = {r["_id"]: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.where("length(text) < 1500").limit(25).collect():
        raw = (r.text or "").lower().encode()
        cuts = [raw[i : i + 64] for i in range(0, max(len(raw) - 32, 1), 32)] if len(raw) > 64 else [raw]
        gain = [size(model.ordinary, w) - size(model.toxic, w) for w in cuts]
        x = [sum(gain) / len(gain), min(gain), float(np.percentile(gain, 90)), max(gain)]
        for margin in (1, 2, 3, 4, 6):
            n = sum(g >= margin for g in gain)
            x += [np.log1p(n), n / len(gain)]
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights[:-1], x, model.mean, model.scale, strict=True)) + model.weights[-1]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9), r.doc_id


def test_toxicity_windows_in_groups(monkeypatch):
    from lakeward.llm import toxicity

    texts = ["", "a", "some plain words " * 9, "VILE words\nand more " * 40, "", "x" * 64, "y" * 65, "é" * 200]
    none = np.zeros(0)
    model = toxicity.Model(b"plain words and more of them " * 20 + b"vile", b"plain words and more of them " * 20 + b"kind", none, none, none)
    both = model.compressors()
    calls = []

    def counted(parts):
        calls.append(len(parts))
        return both[0](parts)

    for group in (1, 7, 65_536):
        monkeypatch.setattr(toxicity, "GROUP", group, raising=False)
        calls.clear()
        got = toxicity.features(texts, counted, both[1])
        cuts = [toxicity.windows(t.lower().encode()) for t in texts]
        assert max(calls) <= group and len(calls) == -(-sum(map(len, cuts)) // group)
        for row, own in zip(got, cuts, strict=True):
            gain = np.array([both[0]([w])[0] - both[1]([w])[0] for w in own])
            want = [gain.mean(), gain.min(), np.percentile(gain, 90), gain.max()]
            for m in toxicity.MARGINS:
                want += [np.log1p((gain >= m).sum()), (gain >= m).mean()]
            assert row == pytest.approx(want, abs=1e-12)
    assert toxicity.features([], *both).shape == (0, got.shape[1])
