"""Phrases, similarity groups and periodic runs against brute force, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import ODD, WORDS, clashing, documents, prose

from tidewire.llm import bpe, groupjoin, lines, minhash, phrases, runs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- phrases ----------------------------------------------------------------------------------------------------

def plain_phrases(rows, least, top, most=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, most + 1):
                    if i + k <= len(w):
                        f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = {q for p, c in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                  if (q := p[i:j]) != p and c >= often[q]}
        found = []
        for p, a in often.items():
            if p not in inside:
                score, k, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                            for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right, k))
        for rank, (score, a, p, left, right, k) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score, k))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]


def phrase_rows(docs, **how):
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, **how).collect())


@pytest.mark.parametrize("slice_bytes", [40, 1 << 22])
def test_phrases_against_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)      # texts are cut within pieces and between them
    rng = random.Random(50)
    few = ["a", "B", "the", "x\x00", "é"]
    texts = [" ".join(rng.choice(few) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(t, rng.choice(["en", "en", "en", None, "und", ""])) for t in texts + ODD + texts[:9]]
    docs = clashing(spark.createDataFrame(rows, "text string, lang string"))
    for least, top in ((3, 2000), (20, 5)):
        want = plain_phrases(rows, least, top)
        assert phrase_rows(docs, least=least, top=top) == want and want
    assert phrase_rows(docs.limit(0)) == []


def test_phrase_arithmetic_passes_64_bits(spark):
    rows = [("in the end " * 300_000, "en"), ("in the end", None)]
    assert phrase_rows(spark.createDataFrame(rows, "text string, lang string")) == plain_phrases(rows, 100, 2000)


def test_slices_count_every_phrase_once():
    rng = random.Random(51)
    for _ in range(300):
        raw = "".join(rng.choice("ab  \n") for _ in range(rng.randint(0, 300))).encode()
        for order in range(1, 6):
            old, phrases.SLICE_BYTES = phrases.SLICE_BYTES, rng.randint(5, 60)
            parts = list(phrases.slices(raw, order))
            phrases.SLICE_BYTES = old

            def grams(text):
                return Counter(tuple(w[i:i + order]) for piece in text.split(b"\n") if (w := piece.split()) for i in range(len(w) - order + 1))
            assert sum((grams(p) for p in parts), Counter()) == grams(raw)


# ---- similarity groups ------------------------------------------------------------------------------------------

def plain_groups(rows, words, percent):
    """(doc_id, size of the set, smallest doc_id reachable) of every row; rows of equal sets are one."""
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def family(rng, base, members, edits):
    out = []
    for _ in range(members):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("group,hot,portion", [(64, 256, 4096), (3, 5, 2)])
def test_groups_against_all_pairs(spark, monkeypatch, group, hot, portion):
    """Families around the threshold, a passage that half of the texts share, short and odd texts, copies."""
    for name, value in (("GROUP", group), ("HOT", hot), ("PORTION", portion)):
        monkeypatch.setattr(groupjoin, name, value)
    rng = random.Random(52)
    passage = prose(rng, 60)
    texts = [t for n in (9, 40, 100, 200) for t in family(rng, prose(rng, n), 12, max(1, n // 25))]
    texts += [f"{prose(rng, 90)} {passage} {prose(rng, 50)}" for _ in range(30)] + [passage, passage + " end"]
    texts += ["A b c", "a B  c", "a b", "one", "ONE"] + texts[:7]
    rows = [(i, t) for i, t in enumerate(texts + ODD)] + [(3, "a text of its own here"), (3, texts[20]), (None, texts[0]), (500, texts[0]), (500, texts[0])]
    rng.shuffle(rows)
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((tuple(r) for r in groupjoin.similar_groups(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    want = plain_groups(rows, 4, 85)
    assert got == want and len({c for _, _, c in want}) < len(rows) - 30
    if group == 3:
        assert groupjoin.similar_groups(docs.limit(0)).count() == 0


def test_a_linked_family_asks_each_group_once(spark, monkeypatch):
    rng, asks, opened = random.Random(7), [], groupjoin._opened
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base[:at] + [f"x{k}"] + base[at + 1:]) for k in range(240) for at in [rng.randrange(150)]]

    def counted(rows):
        asks.append(rows.where("asks").count())
        return opened(rows)

    monkeypatch.setattr(groupjoin, "GROUP", 8)
    monkeypatch.setattr(groupjoin, "HOT", 32)
    monkeypatch.setattr(groupjoin, "_opened", counted)
    found = groupjoin.similar_groups(documents(spark, texts)).select("component_id").distinct().collect()
    assert [r[0] for r in found] == [0]
    assert sum(asks) <= 2 * len(texts)


def test_groups_with_crowded_tokens_against_all_pairs(spark, monkeypatch):
    for name, value in (("GROUP", 3), ("HOT", 5), ("CROWD", 2)):
        monkeypatch.setattr(groupjoin, name, value)
    rng = random.Random(58)
    texts = [t for n in (9, 40, 100, 200) for t in family(rng, prose(rng, n), 14, max(1, n // 18))]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in groupjoin.similar_groups(documents(spark, texts)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(plain_groups(rows, 4, 85))


def most_rows_of_joins(spark, run):
    """The most rows that any join gives out while `run` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    counts = [0]
    for number in range(before, store.executionsCount()):
        done = store.executionsList().apply(number).executionId()
        values, nodes = store.executionMetrics(done), store.planGraph(done).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for metric in map(node.metrics().apply, range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    counts.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    return max(counts)


def test_an_unlinked_family_is_not_paired_class_by_class(spark):
    """A token in the prefixes of 600 unlinked classes: no join gives rows by the square of the classes."""
    rows = spark.range(600).selectExpr(
        "id AS node", "150L AS n", "id AS component", "id + 1 AS place", "id div 64 AS grp", "explode(sequence(1L, 24L)) AS token")
    asked = []
    most = most_rows_of_joins(spark, lambda: asked.extend(groupjoin._rest_asked(rows.select("token", "node", "n", "component", "place", "grp")).collect()))
    assert {tuple(r) for r in asked} == {(node, at) for node in range(600) for at in range(node // 64 + 1)}
    assert 600 * 24 <= most <= 2 * 600 * 24


def test_token_sets():
    rng = random.Random(53)
    texts = ODD + [prose(rng, n) for n in range(12)]
    for text, tokens in zip(texts, groupjoin.token_sets(texts)):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        assert len(tokens) == (len({tuple(w[i:i + 4]) for i in range(len(w) - 3)}) if len(w) > 3 else bool(w))
        assert (tokens[1:] > tokens[:-1]).all()


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(54)
    texts = [t for n in (7, 12, 25, 60) for t in family(rng, prose(rng, n), 15, max(1, n // 12))]
    rows = list(enumerate(texts + ODD))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == plain_groups(rows, 5, 75)


# ---- runs -------------------------------------------------------------------------------------------------------

def plain_runs(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > start and i + p - start >= max(6, 4 * p):
                found.setdefault((start, i + p - start), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    w = [rng.choice("abcd"[:rng.randint(1, 4)]) for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 90]))]
    for _ in range(rng.randint(0, 3)):
        w += [rng.choice("abcd") for _ in range(rng.randint(0, 9))] + w[-rng.randint(1, 12):] * rng.randint(1, 7)
    return w


def test_runs_against_brute_force():
    rng = random.Random(55)
    for _ in range(800):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        assert runs.runs_of(texts) == [plain_runs(w) for w in texts]


def test_runs_of_long_texts():
    n = 60_000
    assert runs.runs_of([["null"] * n])[0] == [(0, n, 1)]
    assert runs.runs_of([["a", "b", "c"] * n])[0] == [(0, 3 * n, 3)]
    assert runs.runs_of([[f"w{i}" for i in range(n // 4)] * 4])[0] == [(0, n, n // 4)]
    assert runs.runs_of([[f"w{i}" for i in range(n)]])[0] == []


def test_runs_query(spark, monkeypatch, tmp_path):
    from tidewire.llm.catalog import QUERIES

    monkeypatch.setattr(runs, "SLICE_WORDS", 50)
    rng = random.Random(56)
    rows = [(i, " ".join(repetitive(rng)) if i % 3 else prose(rng, 30)) for i in range(120)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(7, "again and"), (7, "again and"), (None, "x x x x x x")]
    clashing(spark.createDataFrame(rows, "doc_id bigint, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        want.append((doc_id, len(found), s, m, q, 1000 * m // q if found else None,
                     hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
                     hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    out = QUERIES["op13_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 30 and runs.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ---- lines ------------------------------------------------------------------------------------------------------

def test_lines_with_clashing_names_long_texts_and_repeats(spark):
    rows = [(i, f"only {i}\nfooter line of all\nbody {WORDS[i % 9]} {i}", f"s{i}") for i in range(7)]
    rows += [(7, "footer line of all\n" + "long text " * 40_000 + "\nend", "s1"), (0, *rows[0][1:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for name in ("_row", "_bad", "_text", "row", "bad", "doc", "left", "line", "site", "a.b"):
        docs = docs.selectExpr("*", f"7 AS `{name}`")
    out = lines.cleaned(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and all(r["_bad"] == 7 and r["a.b"] == 7 for r in got.values())
    assert all("footer" not in r["text"] for r in got.values()) and got[7]["text"].endswith("\nend") and got[3]["text"].startswith("only 3\n")


# ---- byte pairs -------------------------------------------------------------------------------------------------

def test_long_words_merge_as_short_ones(monkeypatch):
    import time

    from tokenizers import Tokenizer

    path, rng = words.vocabulary("word_bpe_49k.json"), random.Random(57)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 30, 300, 3000) for letters in ("aab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz")]
    texts += ["e" * 2000, "the" * 900, "x" * 257 + " end"]
    for limit in (bpe.LONG_FRAGMENT, 0):
        monkeypatch.setattr(bpe, "LONG_FRAGMENT", limit)
        own = bpe.ForcedBoundaryBpe(path)
        for t in texts:
            assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "LONG_FRAGMENT", 256)
    start = time.time()
    assert bpe.ForcedBoundaryBpe(path).encode("".join(rng.choice("etaoinshrdlu") for _ in range(200_000)))
    assert time.time() - start < 20
