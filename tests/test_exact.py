"""Distributed operators against brute force, with limits small enough to take every branch."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.functions.simhash import hash_texts, simhash64
from tidewire.functions.text import normalize_fact
from tidewire.operators import admin, chunking, dedup, delivery, facts, keywords, numbering, prompts, queue, routes, rules
from tidewire.operators.numbering import carried, in_ranges, number_rows
from tidewire.operators.similar import dropped_by_leaders, near_pairs
from tidewire.params import Params
from tidewire.plans import catalog
from tidewire.runtime import cut


def near(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1") <= 3


def some_hashes(n, seed, hot=True):
    rng = random.Random(seed)
    out = set()
    base = rng.getrandbits(64)
    while len(out) < n:
        h = rng.getrandbits(64) if rng.random() < 0.3 else base
        if hot and rng.random() < 0.5:      # one block value shared by most rows
            h = (h & ~0xFFFF) | 0x1234
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randint(0, 63)
        if rng.random() < 0.1:
            base = h
        out.add(h - 2**64 if h >= 2**63 else h)
    return sorted(out, key=lambda _: rng.random())


@pytest.mark.parametrize("bucket_rows", [2, 5, 512])
def test_near_pairs_lossless_and_unique(spark, bucket_rows):
    hashes = some_hashes(300, 1)
    df = spark.createDataFrame(list(enumerate(hashes)), "o bigint, h bigint")
    got = [(r.a, r.b) for r in near_pairs(df, "h", "o", bucket_rows=bucket_rows).select("a", "b").collect()]
    want = {(i, j) for j in range(300) for i in range(j) if near(hashes[i], hashes[j])}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_leaders_match_sequential_pass(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)} | {(i, i + 1) for i in range(60, 90)}
    kept = []
    for n in range(91):
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    df = spark.createDataFrame(list(edges), "a bigint, b bigint")
    lost = {r.node for r in dropped_by_leaders(df).collect()}
    assert lost == set(range(91)) - set(kept)


def test_leaders_of_a_long_chain(spark, monkeypatch):
    """A chain of 100 000 in few rounds, with branches and a node of two neighbours at its end."""
    from tidewire.operators import similar

    n, rounds = 100_000, []
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(n - 1, n + 5), (50, n + 5), (n + 5, n + 6), (7, n + 9), (7, n + 9)], "a bigint, b bigint")
    real = similar.cut
    monkeypatch.setattr(similar, "cut", lambda df: rounds.append(df.columns) or real(df))
    lost = {r.node for r in similar.dropped_by_leaders(chain.union(more)).collect()}
    # n - 1 is odd and dropped; 50 is kept and drops n + 5, which frees n + 6; 7 is dropped and leaves n + 9
    assert lost == set(range(1, n, 2)) | {n + 5}
    assert sum("moved" in columns for columns in rounds) <= 25


def test_dedup_by_body_matches_sequential_pass(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(20)]
    texts = []
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t) if i % 17 else "")
    hashes = hash_texts(texts).tolist()
    known = hashes[:3]
    seen, want = list(known), []
    for i, t in enumerate(texts):
        if t and not any(near(hashes[i], s) and hashes[i] and s for s in seen):
            want.append(i)
            seen.append(hashes[i])
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq bigint, content_text string")
    stored = spark.createDataFrame([(h,) for h in known], "simhash bigint")
    got = sorted(r.seq for r in dedup.dedup_by_body(items, "seq", known=stored).collect())
    assert got == want and 20 <= len(want) < 150


def test_url_dedup(spark):
    items = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, ""), (4, "c")], "seq bigint, url string")
    known = spark.createDataFrame([("c",)], "url string")
    assert sorted(r.seq for r in dedup.dedup_by_url(items, "seq", known).collect()) == [0, 1]


def test_number_rows(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 50 == 0 else ("hot" if rng.random() < 0.6 else f"g{i % 5}"), rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, g string, v int")
    got = {r.id: r.p for r in number_rows(df, [F.col("v").desc(), "id"], ["g"], "p").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        for p, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            want[r[0]] = p
    assert got == want


def brute_merge(rows):
    kept = []
    for pos, h, conf in rows:
        hit = next((k for k in kept if near(k[1], h)), None)
        if hit is None:
            kept.append((pos, h, conf))
        elif conf > hit[2]:
            kept.remove(hit)
            kept.append((pos, h, conf))
    return sorted(k[0] for k in kept)


@pytest.mark.parametrize("segment_rows", [3, 500_000])
def test_merge_facts(spark, segment_rows):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i % 2, i, "".join(t), rng.randint(1, 9) / 10))
    df = spark.createDataFrame(rows, "article_id bigint, position bigint, fact string, confidence double")
    norm = {r.position: r.n for r in df.select("position", simhash64(normalize_fact(F.col("fact"))).alias("n")).collect()}
    want = sorted(p for a in (0, 1) for p in brute_merge([(r[1], norm[r[1]], r[3]) for r in rows if r[0] == a]))
    got = sorted(r.position for r in facts.merge_facts(df, segment_rows=segment_rows).collect())
    assert got == want and len(want) < 120


def test_merge_fold_is_linear():
    """A component of one clique with many repeats against the plain rule, and its time at two sizes."""
    import json
    import time

    import numpy as np

    rng = random.Random(12)

    def made(n):
        nodes = [rng.randrange(40) for _ in range(n)]
        return pd.DataFrame({"item": range(n), "node": nodes, "confidence": [rng.randint(0, 9) / 10 for _ in range(n)],
                             "near": [np.array([x for x in range(40) if x != v and (x + v) % 3]) for v in nodes]})

    rows = made(2000)
    kept = []
    for item, node, conf, near in rows.itertuples(index=False):
        match = next((k for k in kept if k[1] == node or k[1] in near), None)
        if match is None or conf > match[2]:
            if match:
                kept.remove(match)
            kept.append([item, node, conf])
    half, state = facts._merge_fold(rows[:700], "")
    assert json.loads(facts._merge_fold(rows[700:], state)[1]) == kept and half is None
    many = pd.DataFrame({"item": range(100_000), "node": range(100_000), "confidence": 0.5, "near": [np.array([], dtype=int)] * 100_000})
    start = time.time()
    facts._merge_fold(many, "")
    assert time.time() - start < 5


def test_merge_fixture(spark):
    df = spark.createDataFrame([
        (1, 0, "公司发布了新产品", 0.6, "国内", "未知"), (1, 1, "公司发布了新产品", 0.9, "国内", "金融经济"), (1, 2, "央行宣布降息", 0.7, "未知", "金融经济")],
        "article_id bigint, position bigint, fact string, confidence double, region string, layer string")
    merged = facts.fill_by_majority(facts.merge_facts(df)).orderBy("position").collect()
    assert [(r.position, r.confidence, r.region, r.layer) for r in merged] == [(1, 0.9, "国内", "金融经济"), (2, 0.7, "国内", "金融经济")]


def brute_words(words, freq):
    used, out = set(), {}
    for w in words:
        if w in used:
            continue
        group = [w]
        for o in words:
            if o != w and o not in used and SequenceMatcher(None, w, o).ratio() > 0.8:
                group.append(o)
                used.add(o)
        used.add(w)
        out[max(group, key=len)] = sum(freq[g] for g in group)
    return out


def test_keyword_merge(spark):
    rng = random.Random(8)
    words = []
    for _ in range(25):
        w = "".join(rng.choice("abcde金融") for _ in range(rng.choice([3, 4, 6, 9, 12, 13, 16, 24])))
        words.append(w)
        for _ in range(6):
            v = list(words[-1])
            for _ in range(rng.randint(1, 3)):
                if rng.random() < 0.5 and len(v) > 2:
                    del v[rng.randrange(len(v))]
                else:
                    v.insert(rng.randrange(len(v) + 1), rng.choice("abcde"))
            words.append("".join(v))
    words = list(dict.fromkeys(words))
    freq = {w: i % 4 + 1 for i, w in enumerate(words)}
    rows = [(i, [w] * freq[w]) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "article_id bigint, keywords array<string>")
    got = {r.word: r.freq for r in keywords.merge_similar(keywords.keyword_counts(df)).collect()}
    assert got == brute_words(words, freq) and len(got) < len(words)


def test_keyword_merge_in_rounds(spark, monkeypatch):
    """The sequential pass over rounds of a few words; a family of similar words makes about one pair a word."""
    rng, made, similar_words = random.Random(8), [], keywords.similar_words
    family = {"".join(w) for w in ([*"abcdefghijk"[:at], c, *"abcdefghijk"[at:]] for at in range(12) for c in "opqrstuvwxyz")}
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(4, 9))) for _ in range(80)} | family, key=lambda _: rng.random())
    groups = []
    for word in words:
        home = next((g for g in groups if SequenceMatcher(None, g[0], word).ratio() > 0.8), None)
        home.append(word) if home else groups.append([word])

    def counted(*args):
        found = similar_words(*args).localCheckpoint()
        made.append(found.where("length(word_a) = 12 AND length(word_b) = 12").count())
        return found

    monkeypatch.setattr(keywords, "similar_words", counted)
    df = spark.createDataFrame([(w, 1, (1, at)) for at, w in enumerate(words)], "word string, freq bigint, first struct<article_id:bigint,at:bigint>")
    got = sorted((r.word, r.words) for r in keywords.merge_similar(df, first_words=8).collect())
    assert got == sorted((max(g, key=len), len(g)) for g in groups)
    assert sum(made) < 4 * len(family)      # 10 296 pairs of the family in one round


@pytest.mark.parametrize("above", [0.75, 0.8, 0.9])
def test_similar_words_of_all_lengths(spark, above):
    """Words of 1 to 40 letters, a quarter of them with a common beginning, against all pairs."""
    rng = random.Random(40)
    words = []
    for n in range(1, 41):
        words.append(("abcabc" if n % 4 == 0 else "") + "".join(rng.choice("abcdé") for _ in range(n)))
        for _ in range(7):
            v = list(words[-1])
            for _ in range(rng.randint(1, 4)):
                if rng.random() < 0.5 and len(v) > 1:
                    del v[rng.randrange(len(v))]
                else:
                    v.insert(rng.randrange(len(v) + 1), rng.choice("abcdé"))
            words.append("".join(v))
    words = list(dict.fromkeys(words))
    df = spark.createDataFrame(list(enumerate(words)), "place bigint, word string")
    got = [(r.a, r.b) for r in keywords.similar_words(df, above).select("a", "b").collect()]
    want = {(i, j) for j in range(len(words)) for i in range(j) if SequenceMatcher(None, words[i], words[j]).ratio() > above}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_few_words_meet_that_are_not_similar(spark, monkeypatch):
    """Words of 10 and 14 letters of a common alphabet: letters are compared as they meet, and parts are longer than two letters."""
    rng, met, by_key = random.Random(14), [], keywords.by_key
    words = sorted({"".join(rng.choice("etanoisrhl") for _ in range(n)) for n in [10, 14] * 300}, key=lambda _: rng.random())
    words += [w[:5] + "x" + w[5:] for w in words[:20]]
    monkeypatch.setattr(keywords, "by_key", lambda df, *k: (met.append(df) if df.columns == ["a", "b"] else None) or by_key(df, *k))
    found = keywords.similar_words(spark.createDataFrame(list(enumerate(words)), "place bigint, word string")).count()
    assert found >= 20 and met[0].count() < 100 * found


def test_matching_blocks_are_those_of_the_library():
    rng = random.Random(21)
    for _ in range(5000):
        letters = rng.choice(["ab", "abcde", "abcdefghijklé"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 45))) for _ in range(2))
        if rng.random() < 0.7:
            b = a[:rng.randint(0, 9)] + b[:3] + a[rng.randint(0, 9):]
        assert keywords._ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_prompts_never_return_to_the_items(spark, tmp_path):
    """Plans read what was sorted once; the items are neither read nor shuffled again."""
    by, path = ["region", "layer"], str(tmp_path / "items")
    rows = [("A", "xy"[n % 2], f"i{n}", float(n % 7), 0.5, f"fact {n}", "") for n in range(90)]
    spark.createDataFrame(rows, "region string, layer string, item_id string, score double, confidence double,"
                                " fact string, opinion string").write.parquet(path)
    items = spark.read.parquet(path)
    for limit in (10, 100_000):
        params = Params(model_limit=limit)
        planned = prompts.plan_section_prompts(items, by, params=params)
        assert not [f for f in planned.inputFiles() if path in f]
        assert planned.count() == 90 and set(items.columns) <= set(planned.columns)
        want = planned.groupBy(*by, "items", "section_tokens").agg((F.max("block") + 1).alias("prompts"))
        plan = prompts.section_plan(items, by, params=params)
        assert sorted(plan.select(want.columns).collect()) == sorted(want.collect())
        assert "Sort" not in plan._jdf.queryExecution().optimizedPlan().toString()
    packed = prompts.pack_by_tokens(items, by, target=100, texts=False)
    assert not [f for f in packed.inputFiles() if path in f] and packed.count() == 90


@pytest.mark.parametrize("segment_rows", [1, 7, 500_000])
def test_pack_by_tokens(spark, segment_rows):
    rng = random.Random(4)
    rows = [(f"i{i:03d}", "r", "l" if i % 3 else "m", rng.random(), 0.5, "w " * rng.choice([1, 5, 30, 90]), "") for i in range(90)]
    df = spark.createDataFrame(rows, "item_id string, region string, layer string, score double, confidence double, fact string, opinion string")
    out = prompts.pack_by_tokens(df, ["region", "layer"], target=100, segment_rows=segment_rows).collect()
    for layer in ("l", "m"):
        ranked = sorted((r for r in out if r.layer == layer), key=lambda r: r["rank"])
        block, carry, want = 0, 0, []
        for r in ranked:
            if r.tokens > 100:
                block, carry = block + 1, 0
            elif carry == 0 or carry + r.tokens > 100:
                block, carry = block + 1, r.tokens
            else:
                carry += r.tokens
            want.append(block)
        assert [r.block for r in ranked] == want
        assert any(r.tokens > 100 for r in ranked)


@pytest.mark.parametrize("gap", [1_200_000_000, 60_000_000, 5_000_000_000])
def test_routes(spark, gap):
    """One domain with most rows; clocks that run backwards now and then; a null domain."""
    rng = random.Random(gap)
    rows, at = [], 0
    for i in range(400):
        at += rng.randint(1, gap) if rng.random() < 0.9 else -rng.randint(1, gap)
        domain = None if rng.random() < 0.05 else f"d{0 if rng.random() < .9 else 1 + i % 3}"
        rows.append((domain, i, at, rng.random() < (0.3 if i % 100 < 50 else 0.8), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "domain string, seq bigint, ts_us bigint, ok boolean, default_proxy boolean")
    got = {r.seq: (r.via_proxy, r.failures, r.switched) for r in routes.route_switches(df).collect()}
    assert len(got) == len(rows)
    for name in {r[0] for r in rows}:
        state = {}
        for _, seq, at, ok, default in (r for r in rows if r[0] == name):
            state, proxy, switched = routes.next_state(state, at, ok, default, 3, routes.HOUR_US)
            assert got[seq] == (proxy, 3 if switched else state.get("count", 0), switched)
    assert any(v[2] for v in got.values())
    islands = routes.with_islands(df, routes.HOUR_US).where("domain = 'd0'").groupBy("island").count().collect()
    assert len(islands) > (20 if gap > 10**9 else 0)


def test_carried_values(spark):
    rng = random.Random(61)
    rows = [(i, "hot" if rng.random() < 0.8 else f"g{i % 3}", None if rng.random() < 0.5 else rng.randint(0, 99)) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, g string, v int")
    placed = in_ranges(df, ["id"], ["g"])
    v = F.col("v")
    got = {r.id: (r.a, r.b, r.c) for r in carried(placed, ["g"], a=("last", v), b=("max", v), c=("min", v)).collect()}
    for g in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == g]
        for k, r in enumerate(mine):
            ahead, rest = [x[2] for x in mine[:k] if x[2] is not None], [x[2] for x in mine[k:] if x[2] is not None]
            assert got[r[0]] == (ahead[-1] if ahead else None, max(ahead, default=None), min(rest, default=None))


def test_rule_hits_against_brute_force(spark):
    texts = [(i, f"alpha {i} beta{i % 3} gamma", "src") for i in range(30)]
    docs = spark.createDataFrame(texts, "k bigint, t string, s string")
    rule = spark.createDataFrame([(1, "ALPHA 1", True, 1), (2, "a2", True, 2), (3, "zz", True, 3), (4, "m", True, 4), (5, "a", False, 5)],
                                 "rule_id bigint, pattern string, is_enabled boolean, priority int")
    found = sorted(tuple(r) for r in rules.rule_hits(docs, rule, "k", "t").select("k", "rule_id", "priority").collect())
    want = sorted((k, r, p) for k, t, _ in texts for r, pat, p in ((1, "alpha 1", 1), (2, "a2", 2), (3, "zz", 3), (4, "m", 4)) if pat in t)
    assert found == want


def test_rule_hits_random_patterns(spark):
    rng = random.Random(31)
    texts = ["".join(rng.choice("aB😀 ç") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    patterns = ["".join(rng.choice("ab😀 Ç") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    rule = spark.createDataFrame([(i, p, True, None, "x") for i, p in enumerate(patterns)],
                                 "rule_id bigint, pattern string, is_enabled boolean, priority int, more string")
    hits = rules.rule_hits(docs, rule, "k", "t")
    assert hits.columns == ["k", "rule_id", "priority", "more"]
    want = sorted((k, i) for k, t in enumerate(texts) for i, p in enumerate(patterns) if p.lower() in (t or "").lower())
    assert sorted((r.k, r.rule_id) for r in hits.collect()) == want and want
    assert rules.rule_hits(docs, rule.limit(0), "k", "t").count() == 0 and rules.rule_hits(docs.limit(0), rule, "k", "t").count() == 0


def test_rule_pieces_are_linear_in_the_text(spark):
    import time

    seconds = []
    for size in (50_000, 50_000, 200_000, 800_000):
        df = spark.range(1, numPartitions=1).select(F.expr(f"repeat('abc déf ', {size // 8})").alias("t"))
        start = time.time()
        assert df.select(F.size(rules._text_pieces(F.col("t")))).first()[0] == 10 + 9 + 7
        seconds.append(time.time() - start)
    assert seconds[2] < 2 and seconds[3] < 4


def test_chunks(spark):
    df = spark.createDataFrame([(["一二", "三四", "五六"],)], "s array<string>")
    chunks = df.select(chunking.pack_sentences(F.col("s"), 5, 2, F.lit("zh")).alias("c")).first().c
    assert chunks == ["一二三四", "三四五六"]
    long = "\n\n".join("这是一个很长的段落" * 5 for _ in range(10))
    docs = spark.createDataFrame([(1, long), (2, "短文"), (3, "")], "seq bigint, content_text string")
    plan = {r.seq: r for r in chunking.plan_chunks(docs, params=Params(model_limit=200, budget=0.2, max_chunks=3)).collect()}
    assert plan[1].degraded and plan[1].total_chunks == 10 and len(plan[1].chunks) == 3 and plan[1].overflow == 7
    assert plan[2].chunks == ["短文"] and not plan[2].degraded and 3 not in plan
    other = chunking.plan_chunks(docs, params=Params(model_limit=200, budget=0.2, max_chunks=3, long_text_strategy="headN_plus_overall"))
    chunks = {r.seq: r.chunks for r in other.collect()}[1]
    assert len(chunks) == 3 and chunks[2] == "[全文概括]\n前2段详细内容已处理，剩余8段需要概括处理。"


@pytest.mark.parametrize("n,size,want", [(0, 3, []), (3, 3, [3]), (5, 2, [2, 2, 1]), (10, 3, [3, 3, 3, 1])])
def test_batches(spark, n, size, want):
    df = spark.createDataFrame([(i, f"u{i}@x.com") for i in range(n)], "seq bigint, email string")
    got = delivery.batches(df, "seq", size).orderBy("batch_no").collect()
    assert [r.recipients for r in got] == want
    flat = [e for r in got for e in [*r["to"], *r.bcc]]
    assert flat == [f"u{i}@x.com" for i in range(n)]


def test_preferences(spark):
    schema = "user_email string, name string, scope string, prompt_text string, is_default boolean, seq bigint"
    saves = [("u", "a", "g", "1", True, 1), ("u", "b", "g", "2", True, 2), ("u", "b", "g", "3", False, 3)]
    saves += [("v", f"t{i}", "g", "x", False, i) for i in range(10, 17)] + [("v", "t10 ", "g", "new", True, 20)]
    df = spark.createDataFrame(saves, schema)
    out = {(r.user_email, r.name): (r.prompt_text, r.is_default) for r in admin.save_preferences(df, df.limit(0)).collect()}
    assert out[("u", "a")] == ("1", False) and out[("u", "b")] == ("3", False)
    assert len([k for k in out if k[0] == "v"]) == 5 and out[("v", "t10")] == ("new", True)


def test_queue_state(spark):
    events = [(1, 0, "queued", None, 0), (1, 1, "running", None, None), (1, 2, "failed", "boom", None), (1, 3, "queued", None, 100),
              (2, 4, "queued", None, 0), (2, 5, "running", None, None), (2, 6, "done", None, None)]
    df = spark.createDataFrame(events, "article_id bigint, seq bigint, status string, error string, priority int").withColumn(
        "ts", F.timestamp_seconds("seq"))
    got = {r.article_id: r for r in queue.queue_state(df).collect()}
    assert (got[1].status, got[1].attempts, got[1].priority, got[1].last_error, got[1].started_at) == ("queued", 1, 100, None, None)
    assert got[2].status == "done" and got[2].finished_at is not None


def test_stream_matches_batch(spark):
    from harness import TESTDATA
    from tidewire.plans import catalog

    catalog.load()
    d = f"{TESTDATA}/sf0.001"
    key = ["domain", "seq", "via_proxy", "failures", "switched"]
    batch = catalog.QUERIES["route_switches"](spark, d).select(key).toPandas().sort_values("seq", ignore_index=True)
    stream = catalog.QUERIES["stream_route_switches"](spark, d).select(key).toPandas().sort_values("seq", ignore_index=True)
    pd.testing.assert_frame_equal(batch, stream)


def test_route_state_expires(spark, tmp_path):
    """State rows fall to zero once the holds are over; a domain with open failures keeps its row."""
    from tidewire.streaming import jobs

    hour, source = routes.HOUR_US, str(tmp_path / "in")
    fields = "domain string, seq bigint, ts_us bigint, ok boolean, default_proxy boolean"
    batches = [[("a", k, k * 1_000_000, False, False) for k in range(3)] + [("b", 3, 1_000_000, True, False)],
               [("a", 5, 1_800_000_000, True, False), ("c", 6, 1_800_000_000, False, False)],
               [("c", 7, 2 * hour, True, False)], [("d", 8, 4 * hour, True, False)], [("d", 9, 5 * hour, True, False)]]
    for rows in batches:
        rows = [(d, n, 1_700_000_000_000_000 + at, ok, default) for d, n, at, ok, default in rows]
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(source)
    files = sorted(tmp_path.glob("in/*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == len(batches)
    spark.conf.set(jobs.STATE_STORE, jobs.ROCKS)
    try:
        stream = jobs.route_switch_stream(jobs.landed(spark, source, "*", fields, files_per_batch=1), late="0 seconds")
        query = (stream.writeStream.option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True)
                 .format("parquet").option("path", str(tmp_path / "out")).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(jobs.STATE_STORE)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = {r.seq: (r.via_proxy, r.failures, r.switched) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[2] == (False, 3, True) and got[5] == (True, 0, False) and got[6] == (False, 1, False) and len(got) == 9
    assert max(kept) >= 2 and kept[-1] == 0


def test_history_reads_only_buckets_of_known_keys(spark, tmp_path, monkeypatch):
    from tidewire.streaming import jobs

    target, touched = str(tmp_path / "seen"), []
    real = jobs.touched_buckets
    monkeypatch.setattr(jobs, "touched_buckets", lambda fresh, filters: touched.append(real(fresh, filters)) or touched[-1])
    write = jobs.append_unseen(target, "url", "seq", buckets=16)
    frames = [[(k, f"u{k}") for k in range(400)], [(k, f"v{k}") for k in range(40)] + [(99, "u7"), (100, "v3")], [(1, f"w{k % 5}") for k in range(9)]]
    for number, rows in ((0, frames[0]), (1, frames[1]), (2, frames[2]), (1, frames[1])):      # the second batch is run again
        write(spark.createDataFrame(rows, "seq bigint, url string"), number)
    got = spark.read.parquet(target)
    assert sorted(r.url for r in got.collect()) == sorted(f"{c}{k}" for c, n in (("u", 400), ("v", 40), ("w", 5)) for k in range(n))
    bucket = got.where("url = 'u7'").first().bucket
    assert touched == [[bucket], [], [bucket]]
    files = got.where(F.col("bucket").isin(touched[0]) & (F.col("batch_id") != 1)).select(F.input_file_name().alias("f")).distinct()
    assert all(f"bucket={bucket}/" in r.f for r in files.collect()) and files.count() < len(got.inputFiles()) / 10


def test_prompt_lines_are_ranked_without_their_texts(spark, monkeypatch):
    catalog.load()
    moved = []
    monkeypatch.setattr(numbering, "cut", lambda df: moved.append(set(df.columns)) or cut(df))
    assert catalog.QUERIES["prompt_lines"](spark, "/root/testdata/sf0.001").count()
    assert moved and not any(columns & {"item_id", "fact", "opinion"} for columns in moved)
