import pytest
from pyspark.sql import functions as F

from loomgraph.functions import fuzzy, records
from loomgraph.functions import text as T


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, want",
    [(None, None), ("", None), ("  \n", None), ("Hello   World", "hello world"), ("a https://x.y/z b", "a b"), ("www.a.com", None), ("a  b", "a b")],
)
def test_normalize_text(spark, text, want):
    assert one(spark, text, T.normalize_text) == want


@pytest.mark.parametrize(
    "text, want",
    [("plain words", "latin"), ("नक्सल क्षेत्र", "devanagari"), ("ٹیسٹ اردو", "arabic"), ("some latin text " * 20 + "नक्सलक्षेत्रनक्सलक्षेत्र", "mixed"), ("🙂🙂", None), ("", None), (None, None), ("123 456", None)],
)
def test_script(spark, text, want):
    assert one(spark, text, T.script) == want


def test_language_rules(spark):
    assert one(spark, "the cat", T.language) is None
    assert one(spark, "the cat and the dog", T.language) == "en"
    assert one(spark, "der Hund und die Katze", T.language) == "de"
    assert one(spark, "some latin text " * 20 + "नक्सलक्षेत्रनक्सलक्षेत्र", T.language) is None


def test_entities(spark):
    e = one(spark, "mail info.x@mail.com or @some_one, see https://a.b/c #tag #नक end", T.entities)
    assert (e["urls"], e["hashtags"], e["mentions"], e["handles"], e["named_entities"]) == (["https://a.b/c"], ["#tag", "#नक"], ["@some_one"], ["some_one"], [])


def test_media_hash(spark):
    import hashlib

    assert one(spark, ["a", "", None, "b"], T.media_hash, "array<string>") == hashlib.sha256(b"a:b").hexdigest()
    assert one(spark, ["", None], T.media_hash, "array<string>") is None


@pytest.mark.parametrize("text, want", [("PT4M13S", 253), ("PT1H", 3600), ("PT", 0), ("P1D", None), ("", None), (None, None), ("xPT1S", None)])
def test_duration(spark, text, want):
    assert one(spark, text, records.duration_seconds) == want


def test_small_records(spark):
    assert one(spark, {"high": "", "medium": "m"}, records.best_thumbnail, "map<string,string>") == "m"
    assert one(spark, "see https://youtu.be/abc-123 now", records.video_id) == "abc-123"
    assert one(spark, "https://youtube.com/channel/UC_1", records.channel_id) == "UC_1"
    assert one(spark, "telegram:-100:5", records.forward_ref_channel) == -100
    assert one(spark, "telegram:x:5", records.forward_ref_channel) is None
    assert one(spark, "a", lambda c: records.title_text(c, F.lit(None).cast("string"))) == "a"
    assert one(spark, "2024-01-01T05:30:00+05:30", records.parse_time).isoformat() == "2024-01-01T00:00:00"
    assert one(spark, "nonsense", records.parse_time) is None
    assert tuple(one(spark, "telegram:a:b", records.author_parts)) == ("telegram", "a:b")
    assert one(spark, [("a", 1), ("b", 2), ("a", 3)], records.reactions_map, "array<struct<name:string,count:int>>") == {"a": 3, "b": 2}
    assert one(spark, ("document", "video/mp4"), records.media_kind, "struct<kind:string,mime_type:string>") == "video"
    assert one(spark, "12", lambda c: records.visible_subscribers(c, F.lit(True))) is None
    assert one(spark, "12", lambda c: records.visible_subscribers(c, F.lit(None).cast("boolean"))) == 12
    spans = [("url", "http://a", None), ("text_url", "x", "http://b"), ("hashtag", "#h", None), ("mention", "@m", None)]
    e = one(spark, spans, records.message_entities, "array<struct<kind:string,text:string,url:string>>")
    assert (e["urls"], e["hashtags"], e["handles"]) == (["http://a", "http://b"], ["#h"], ["m"])


def test_answers(spark):
    raw = '```json\n[{"surface_form": "A", "entity_type_guess": "ORG", "canonical_name": "Acme", "confidence": "0.5"}, {"surface_form": "B"}, 3]\n```'
    got = one(spark, raw, records.parse_mentions)
    assert [tuple(r) for r in got] == [("A", "org", "Acme", 0.5)]
    assert one(spark, "no json", records.parse_mentions) == []
    assert one(spark, '{"a": 1}', records.parse_mentions) == []
    raw = '[{"index": 1, "polarity": "POSITIVE", "strength": 2, "confidence": -1}, {"index": 3, "polarity": "positive", "strength": 1, "confidence": 1}, {"index": 2, "polarity": "odd", "strength": 1, "confidence": 1}]'
    got = one(spark, raw, lambda c: records.parse_stances(c, F.array(F.lit("e1"), F.lit("e2"))))
    assert [tuple(r) for r in got] == [("e1", "positive", 1.0, 0.0)]


@pytest.mark.parametrize("a, b, lcs", [("Ali Mirza", "Muhammad Ali Mirza", 9), ("Modi", "Modi Motors", 4), ("abcbdab", "bdcaba", 4), ("", "a", 0), ("", "", 0)])
def test_ratio(spark, a, b, lcs):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(fuzzy.ratio(F.col("a"), F.col("b")).alias("r")).first()["r"]
    want = 200 * lcs / (len(a) + len(b)) if a or b else 100.0
    assert got == pytest.approx(want) and fuzzy._ratio(a, b) == pytest.approx(want)


def test_token_set(spark):
    pairs = [("Ali Mirza", "Mirza Ali Khan", 100.0), ("a b", "c d", pytest.approx(100 * 2 * 1 / 6)), ("", "x", 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r["s"] for r in df.select(fuzzy.token_set_ratio("a", "b").alias("s")).collect()]
    assert got[0] == pairs[0][2] and got[2] == 0.0 and got[1] == pairs[1][2]
