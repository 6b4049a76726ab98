"""Literal cases for the column functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import responses as RP
from tidewire.functions import scoring as S
from tidewire.functions import text as T
from tidewire.functions import times as D
from tidewire.functions import urls as U
from tidewire.operators import delivery as DL
from tidewire.operators import usage as US


def values(spark, inputs, expression, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {type_}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "http://a.com/x/#top": "https://a.com/x", "https://a.com/": "https://a.com", "http://a.com/x/?q=1#f": "https://a.com/x?q=1",
        "HTTP://A.com/Y": "https://A.com/Y", "https://a.com?": "https://a.com", "http://a.com//b//": "https://a.com//b",
        "ftp://a.com/x/": "ftp://a.com/x", "/rel/": "/rel",
    }
    assert values(spark, cases, U.normalize_url) == list(cases.values())


def test_resolve(spark):
    base = F.lit("https://site.com/news/list/index.html?p=1")
    cases = {
        "/x": "https://site.com/x", "../y": "https://site.com/news/y", "z?a=1": "https://site.com/news/list/z?a=1",
        "//cdn.com/p/": "https://cdn.com/p", "http://o.com/": "https://o.com", "./k/": "https://site.com/news/list/k",
        "../../../up": "https://site.com/up", "mailto:a@b.c": "mailto:a@b.c", " ": None, "?p=2": "https://site.com/news/list/index.html?p=2",
    }
    assert values(spark, cases, lambda h: U.resolve_static(base, h)) == list(cases.values())
    dynamic = {"/x": "https://site.com/x", "../x": "https://site.com/news/x", "https://o.com/a/": "https://o.com/a/", "": ""}
    assert values(spark, dynamic, lambda h: U.resolve_dynamic(base, h)) == list(dynamic.values())


def test_validity(spark):
    static = {"https://a.com/news/1": True, "https://a.com/news/1.pdf": False, "https://a.com/about": False,
              "https://a.com/blog/tag/x": False, "ftp://a.com/news/1": False, "": False}
    assert values(spark, static, U.valid_static) == list(static.values())
    ruled = {"https://www.a.com/x/1": True, "https://b.com/x/1": False, "https://a.com/y": False}
    got = values(spark, ruled, lambda u: U.valid_static(u, F.array(F.lit("/x/")), None, F.array(F.lit("a.com"))))
    assert got == list(ruled.values())
    source = F.lit("https://example.com/news")
    dynamic = {"https://example.com/article/1": True, "https://example.com/news/2": True, "https://other.com/article/1": False,
               "https://example.com/about": False, "mailto:x": False}
    allow = F.array(F.lit("/article/"), F.lit("/news/"))
    assert values(spark, dynamic, lambda u: U.valid_dynamic(u, source, allow)) == list(dynamic.values())


def test_domain(spark):
    cases = {"http://www.bbc.co.uk:80/x": ("bbc.co.uk", "foreign"), "https://m.163.com/a": ("m.163.com", "domestic"),
             "nothing": ("nothing", "unknown"), "https://example.com": ("example.com", "unknown")}
    assert values(spark, cases, U.domain_of) == [v[0] for v in cases.values()]
    assert values(spark, cases, lambda u: U.domain_class(U.domain_of(u))) == [v[1] for v in cases.values()]


def test_text(spark):
    assert values(spark, ["  a \r\n\r\n b\rc　", None, "x"], T.clean_text) == ["a\nb\nc", "", "x"]
    assert values(spark, ["<p>Hi <b>you</b> &amp; me</p><script>x</script>", "1 < 2"], T.plain_text) == ["Hi you & me", "1 < 2"]
    assert values(spark, ["今天金融市场上涨", "this is plain english text", "今天上涨 we see mixed 金融", "", None], T.detect_language) == [
        "zh", "en", "mixed", "zh", "zh"]
    assert values(spark, ["今天上涨了"], lambda t: T.estimate_tokens(t, F.lit("zh"))) == [5]
    assert values(spark, ["one two three four"], lambda t: T.estimate_tokens(t, F.lit("en"))) == [5]
    assert values(spark, ["上涨 two three", "a上b c"], lambda t: T.estimate_tokens(t, F.lit("mixed"))) == [4, 3]
    assert values(spark, ["a\n\nb\n\n\n c ", "One. Two! Three", "Hi... ok", " "], lambda t: F.array_join(T.split_semantic(t), "|")) == [
        "a|b|c", "One. |Two! |Three", "Hi.|.|. |ok", ""]


def test_normalize_fact(spark):
    cases = {"增长（三 十）％！": "增长(30)％!", " 二〇二五年，  收入": "2025年,收入".replace(",收入", ", 收入"), "1 0 2": "102", "三十": "310",
             "零 十": "0", "a“b”‘c’": "a\"b\"'c'", "5  10 x": "50 x"}
    assert values(spark, cases, T.normalize_fact) == list(cases.values())


def test_previews_and_numbers(spark):
    assert values(spark, ["abcdef", "abc"], lambda t: T.preview(t, 3)) == ["abc...", "abc"]
    assert values(spark, [999, 1500, 2_500_000], T.token_amount, "bigint") == ["999", "1.5K", "2.5M"]
    assert values(spark, [0.85], T.percent, "double") == ["85%"]
    assert values(spark, [1.5], lambda v: T.money(v, 4), "double") == ["1.5000"]


def test_dates(spark):
    cases = {
        "Mon, 06 Jan 2025 10:00:00 GMT": datetime(2025, 1, 6, 18), "Mon, 6 Jan 2025 10:00:00 +0800": datetime(2025, 1, 6, 10),
        "2025-01-06T10:00:00Z": datetime(2025, 1, 6, 18), "2025-01-06T10:00:00+08:00": datetime(2025, 1, 6, 10),
        "2025-01-06 10:00:00": datetime(2025, 1, 6, 10), "2025年1月6日": datetime(2025, 1, 6), "soon": None,
        "06 Jan 2025 10:00:00 EST": datetime(2025, 1, 6, 23), "January 6, 2025": datetime(2025, 1, 6),
    }
    assert values(spark, cases, D.parse_local) == list(cases.values())


@pytest.mark.parametrize("start,end,clock,inside", [
    ("06:00", "08:00", "07:00:00", True), ("06:00", "08:00", "05:59:59", False), ("06:00", "08:00", "08:00:00", True),
    ("06:00", "08:00", "08:00:01", False), ("23:00", "01:00", "23:30:00", True), ("23:00", "01:00", "00:30:00", True),
    ("23:00", "01:00", "12:00:00", False), ("23:00", "01:00", "01:00:00", True)])
def test_time_window(spark, start, end, clock, inside):
    moment = datetime.fromisoformat(f"2025-01-01T{clock}")
    assert values(spark, [moment], lambda t: D.in_time_window(t, start, end), "timestamp_ntz") == [inside]


def test_score(spark):
    row = spark.range(1).select(
        S.score(F.lit(0.8), F.lit(None).cast("timestamp"), F.expr("timestamp'2025-01-01 12:00:00'"), F.lit(1.0), F.lit(1.0)).alias("none"),
        S.score(F.lit(1.0), F.expr("timestamp'2025-01-01 00:00:00'"), F.expr("timestamp'2025-01-01 12:00:00'"), F.lit(3.0), F.lit(0.0)).alias("half"),
        S.same_content(F.lit(0), F.lit(0)).alias("zero"), S.same_content(F.lit(-1), F.lit(-8)).alias("near"),
        S.same_content(F.lit(1), F.lit(-1)).alias("far")).first()
    assert round(row.none, 6) == 0.87 and round(row.half, 6) == 0.65
    assert (row.zero, row.near, row.far) == (False, True, False)


def test_cost(spark):
    cases = [("deepseek", "deepseek-chat", 1000, 500, "exact", 0.0035), ("DeepSeek", "deepseek-chat", 1000, 500, "exact", 0.0035),
             ("qwen", "qwen-max", 2000, 1000, "exact", 0.036), ("qwen", "new", 2000, 1000, "default", 0.036),
             ("qwen", "Qwen-Max", 1, 0, "default", 0.000006), ("other", "x", 1000, 500, "fallback", 0.002), ("qwen", "qwen-plus", 0, 0, "exact", 0.0)]
    df = spark.createDataFrame([c[:4] for c in cases], "provider_name string, model_name string, prompt_tokens bigint, completion_tokens bigint")
    got = {(r.provider_name, r.model_name): (r.price_source, float(r.cost)) for r in US.with_cost(df).collect()}
    assert got == {c[:2]: c[4:] for c in cases}
    plan = spark.createDataFrame([("deepseek", "deepseek-chat", 10000)], "provider_name string, model_name string, tokens bigint")
    # 10000 * (1 - 0.7) is just below or at 3000 and is cut to a whole number
    assert float(US.estimate_cost(plan, "tokens").first().cost) in (0.023, 0.022997)


def test_mail(spark):
    good = ["a@b.com", "x.y+z@sub.example.org"]
    bad = ["", "a", "a@b", "@b.com", "a b@c.com", "a@.c", "a@b.c"]
    assert values(spark, good + bad, DL.is_email) == [True] * 2 + [False] * 7
    hard = ["User unknown", "No such user here", "550 rejected", "Domain not found", "Mailbox disabled", "permanent failure"]
    soft = ["timeout", "try again later", "", None]
    assert values(spark, hard + soft, DL.is_hard_bounce) == [True] * 6 + [False] * 4


def test_response(spark):
    text = '{"items": [{"fact": "f", "confidence": 0.9}], "keywords": ["k"]}'
    inputs = [text, f"note\n```json\n{text}\n``` end", f"```\n{text}\n```", text.replace('"f"', "“f”"), text[:-5], "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "article_id int, content string").withColumn("chunk_index", F.lit(0))
    from tidewire.operators.responses import parse_responses
    got = [(r.status, len(r["items"])) for r in parse_responses(df).orderBy("article_id").collect()]
    assert got == [("success", 1)] * 4 + [("failed", 0)] * 2
    assert values(spark, ["金融科技", "经济", "x", None], RP.stored_layer) == ["金融科技应用", "金融经济", "未知", "未知"]


def test_simhash_memory_is_a_small_multiple_of_the_text():
    """The bits of the grams are spread out by slices, not for a whole text or block at once."""
    import tracemalloc

    from tidewire.functions import simhash as S

    text = " ".join(f"word{i % 977} {i * 7919 % 4001}" for i in range(200_000))
    S.hash_texts(["warm up the tables"])
    tracemalloc.start()
    got = S.hash_texts([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == S._hash_wide("".join(c for c in text.lower() if c.isalnum() or c == "_"))
    assert peak < 65 * len(text), peak / len(text)


def test_simhash_of_many_and_of_wide_texts_equals_the_plain_count():
    from tidewire.functions import simhash as S

    texts = ["a", "abc", "abcd" * 300, "", None, "😀ж𠀀𠀁𠀂𠀃" * 90, "xyz_ é" * 70, "  ", "Σας İ"] * 40
    plain = {t: 0 if not t else int(S._hash_wide("".join(c for c in t.lower() if c.isalnum() or c == "_").ljust(S.GRAM, "\0"))[0])
             for t in texts}
    assert S.hash_texts(texts).tolist() == [plain[t] for t in texts]


def test_stored_references_are_hashed_once(spark):
    from tidewire.plans import ingest_queries as Q

    rows = Q.known_references(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_answers_are_parsed_once(spark):
    """A filter on what an answer holds must not repeat its parsing."""
    from tidewire.operators.responses import article_keywords, parse_responses

    rows = spark.createDataFrame([(1, 0, '{"items":[],"keywords":["a"]}'), (2, 0, "no"), (3, 1, '{"keywords":["b"]}')],
                                 "article_id long, chunk_index int, content string")
    found = article_keywords(parse_responses(rows))
    assert [(r.article_id, r.keywords) for r in found.collect()] == [(1, ["a"])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_small_scopes_are_not_banded(spark):
    """Pairs are the same whatever the bucket size; a scope below it makes no row per band."""
    import random

    from tidewire.operators.similar import near_pairs

    draw = random.Random(5)
    base = [draw.getrandbits(63) for _ in range(6)]
    rows = [(s, i * 10 + s, base[i % 6] ^ (1 << draw.randrange(63)) ^ (1 << draw.randrange(63))) for s in range(3) for i in range(8 * (s + 1))]
    df = spark.createDataFrame(rows, "s int, o long, h long").dropDuplicates(["s", "h"])
    kept = df.collect()
    want = sorted((a.s, a.o, b.o) for a in kept for b in kept
                  if a.s == b.s and a.o < b.o and bin((a.h ^ b.h) & (1 << 64) - 1).count("1") <= 3)
    assert want
    for size in (2, 10, 20, 512):
        got = sorted((r.s, r.a, r.b) for r in near_pairs(df, "h", "o", scope=["s"], bucket_rows=size).collect())
        assert got == want, size
    assert "explode" not in near_pairs(df, "h", "o", scope=["s"])._jdf.queryExecution().optimizedPlan().toString()


def test_rule_pieces_in_arrays_equal_a_plain_count(spark):
    import random

    import numpy as np

    from tidewire.operators import rules as R

    draw = random.Random(9)
    texts = ["", "a", "ab", "abc"] + ["".join(draw.choice("ab😀 çxyz\n") for _ in range(draw.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    every = R._wanted_keys(np.ones(1 << R.SLOT_BITS, dtype=bool))
    for text, keys in df.select("t", every(F.col("t"))).collect():
        assert sorted(keys) == sorted({R.piece_key(text[i:i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1)})
    rule = spark.createDataFrame([(1, "abç", True, 1)], "rule_id int, pattern string, is_enabled boolean, priority int")
    plan = R.rule_hits(df, rule, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_daily_job_parses_no_answer_of_other_articles(spark):
    from tidewire.params import DEFAULTS
    from tidewire.plans import daily

    item = '{"fact":"A fact that is long enough to be stored as an item","region":"国内","layer":"金融科技","confidence":0.9}'
    answers = spark.createDataFrame([(k, 0, '{"items":[' + item + ']}') for k in range(4)], "article_id bigint, chunk_index int, content string")
    ready = spark.sql("SELECT CAST(2 AS BIGINT) AS seq, timestamp'2024-01-01' AS published_at, CAST(1 AS BIGINT) AS source_id")
    found = daily._extracted(answers, ready, False, DEFAULTS)
    assert [r.item_id for r in found.collect()] == ["2-0-0"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan[:plan.index("LeftSemi")]
