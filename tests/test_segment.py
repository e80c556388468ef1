"""Scenarios of the segmenter, the text functions and the streams."""

import random
import time

import pytest
from cuewright.functions import text as X
from cuewright.functions import timecode as T
from cuewright.operators.segment import Block, Segmenter, Spoken, Style
from pyspark.sql import functions as F


def word(text, start, end, speaker="a", **more):
    return {"text": text, "start": start, "end": end, "speaker_id": speaker} | more


def test_hold_times_leave_a_gap():
    blocks = Segmenter().segmented([word("これは", 0.0, 0.3), word("テスト", 0.3, 0.6), word("です。", 0.6, 1.0), word("次", 1.1, 1.3), word("です？", 1.3, 1.6)])
    assert [(b.start, round(b.end, 3)) for b in blocks] == [(0.0, 1.02), (1.1, 2.1)]


def test_words_are_cleaned_and_split():
    seg = Segmenter()
    items = [word("。19", 2, 3), word("x", 1, 0.5), word("", 0, 1), word("noise", 0, 1, type="audio_event"), word("b", 1, 2), word("a", 0, 1)]
    assert [(w["text"], w["start"], w["end"]) for w in seg.words(items)] == [("a", 0, 1), ("b", 1, 2), ("。", 2, 2), ("19", 2, 3)]


def test_cuts():
    seg = Segmenter()
    cut = lambda items: [u.text for u in seg.utterances(seg.words(items))]
    assert cut([word("あい", 0, 1), word("うえ", 1, 2, "b")]) == ["あい", "うえ"]  # another speaker
    assert cut([word("こんにちは皆さん", 0, 1), word("元気ですかみなさま", 2, 3)]) == ["こんにちは皆さん", "元気ですかみなさま"]  # silence
    assert cut([word("こんにちは", 0, 1), word("を", 2, 3)]) == ["こんにちはを"]  # a particle can't open
    assert cut([word("こんにちは", 0, 1), word("ね。", 2, 3)]) == ["こんにちはね。"]  # a short tail
    assert cut([word("さ", 0, 0.7), word("行きましょうみんなで", 2, 3)]) == ["さ行きましょうみんなで"]  # a drawn-out kana
    assert cut([word("はい。", 0, 1), word("次", 1, 2)]) == ["はい。", "次"]  # a hard mark
    long = [word("春夏秋冬、", i, i + 1) for i in range(10)]
    assert all(len(u) <= 44 for u in cut(long)) and "".join(cut(long)) == "春夏秋冬、" * 10


def test_blocks_keep_their_limits():
    rng, seg = random.Random(1), Segmenter()
    for _ in range(60):
        at, items = 0.0, []
        for _ in range(rng.randint(1, 60)):
            at += rng.choice([0, 0, 0.04, 0.2, 0.9])
            lasts = rng.random()
            items.append(word("".join(rng.choice("あいのはをカー漢字ab。、？") for _ in range(rng.randint(1, 6))), at, at + lasts, rng.choice(["a", "a", "b", None])))
            at += lasts * rng.choice([1, 1, 0.5])
        words = seg.words(items)
        spoken = seg.utterances(words)
        strip = lambda t: t.replace(" ", "")
        assert strip("".join(u.text for u in spoken)) == strip("".join(w["text"] for w in words))
        assert all(len(b.parts) <= 5 for b in seg.blocks(spoken))
        held = seg.segmented(items)
        assert all(a.end <= b.start + 1e-9 for a, b in zip(held, held[1:])) and all(b.end > b.start for b in held)


def test_wrapping():
    seg = Segmenter(Style(line_chars=10))
    assert seg.wrapped("短い") == ["短い"]
    assert seg.wrapped("今日は晴れ、明日は雨です") == ["今日は晴れ、", "明日は雨です"]
    assert seg.text_of(Block(0, 1, [Spoken("a", 0, 1, "一"), Spoken("b", 0, 1, "二")])) == "-一\n-二"
    assert len(seg.wrapped("あ" * 45, 2)) == 2


def test_overlaps():
    seg = Segmenter()
    a, b = Block(0, 2, [Spoken("a", 0, 2, "x")]), Block(1, 3, [Spoken("b", 1, 3, "y")])
    assert [(m.start, m.end, len(m.parts)) for m in seg.without_overlaps([a, b])] == [(0, 3, 2)]
    assert [(s.start, s.end) for s in seg.separated([Block(0, 2), Block(1, 3)])] == [(0, 1), (1, 3)]
    assert [(s.start, s.end) for s in seg.separated([Block(0, 2), Block(0.1, 1)])] == [(0, 2), (2, 2.35)]


CLEAN = [("，你好。", "你好"), ("－ 好", "-好"), ("等....", "等…"), ("「好。」", "「好」"), ("好帥。 很有型", "好帥，很有型"), ("-- x", "-- x"), ("", "")]


def test_clean_lines(spark):
    rows = spark.createDataFrame(CLEAN, "raw string, want string").select(X.clean_text(F.col("raw")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


SPACED = [("我是Diane津田嗎", "我是 Diane津田 嗎"), ("看Long  Coat Daddy。", "看 Long Coat Daddy。"), ("LongCoatDaddy", "Long Coat Daddy"), ("Diane Diane津田", "Diane Diane津田"), ("無", "無")]


@pytest.mark.parametrize("raw, want", SPACED)
def test_name_spacer(raw, want):
    space = X.name_spacer(["Diane津田", "Diane", "Long Coat Daddy", "金屬"])
    assert space(raw) == want and space(space(raw)) == want


def test_folding(spark):
    rows = spark.createDataFrame([("カタカナー！", "かたかな"), ("ＡＢＣ　Straße", "abcstrasse"), (None, None)], "raw string, want string")
    got = rows.select(X.folded(F.col("raw")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_source_ids(spark):
    cases = [("https://www.bilibili.com/video/BV1ZArvBaEqL", "BV1ZArvBaEqL", "bilibili"), ("v=abc", "v=abc", "youtube"), ("https://youtu.be/xyz?t=1", "v=xyz", "youtube"), ("https://www.youtube.com/watch?v=q-1&x=2", "v=q-1", "youtube"), ("https://tver.jp/episodes/ep123", "ep123", "tver"), ("90-979_s1", "90-979_s1", "abema"), ("https://nowhere.org/a", None, None)]
    rows = spark.createDataFrame([c[:2] + (c[2],) for c in cases], "s string, id string, p string")
    got = rows.select(X.source_id(F.col("s")).alias("got"), "id", "p").withColumn("site", X.platform(F.col("got"))).collect()
    assert [(r["got"], r["site"]) for r in got] == [(r["id"], r["p"]) for r in got]


def test_times(spark):
    rows = spark.createDataFrame([(3723.0045,), (-1.0,), (360000.0,)], "s double").select(T.stamp_seconds(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["01:02:03,004", "00:00:00,000", "100:00:00,000"]


def test_streams(spark, tmp_path):
    from cuewright.streaming.sessions import stream_sessions
    from cuewright.streaming.utterances import stream_utterances

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("a"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 minutes")).alias("b"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    batch = stream_sessions(events, "user_id", "a", "b")
    stream = stream_sessions(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), "user_id", "a", "b")
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = {tuple(r) for r in spark.table("sessions").collect()}
    assert closed and closed <= {tuple(r) for r in batch.collect()}

    words = spark.createDataFrame([(1, "a", 0.0, 0.5), (1, "b", 0.6, 1.0), (1, "c", 2.0, 2.5), (2, "x", 0.0, 1.0), (2, "y", 5.0, 6.0)], "project_id bigint, text string, start double, end double")
    words.coalesce(1).write.parquet(f"{tmp_path}/words")
    out = stream_utterances(spark.readStream.schema(words.schema).parquet(f"{tmp_path}/words"), idle_seconds=1)
    query = out.writeStream.format("memory").queryName("spoken").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(processingTime="500 milliseconds").start()
    until = time.time() + 90
    while time.time() < until and spark.table("spoken").count() < 4:
        time.sleep(0.5)
    query.stop()
    assert {tuple(r) for r in spark.table("spoken").collect()} == {(1, 0.0, 1.0, "a b"), (1, 2.0, 2.5, "c"), (2, 0.0, 1.0, "x"), (2, 5.0, 6.0, "y")}


def test_turns_and_islands_equal_whole_folds(spark):
    """Dealing out turns and islands gives what folding a project as a whole does."""
    from cuewright.operators.segment import resolved, subtitles, utterances

    rng, style, rows = random.Random(6), Style(), []
    for project in range(12):
        at = 0.0
        for k in range(120):
            at += rng.choice([0.0, 0.0, 0.1, 0.3, 0.75, 1.5]) if rng.random() < 0.4 else 0
            lasts = rng.choice([0.05, 0.1, 0.3, 0.9])
            rows.append((project, k, rng.choice(["あ", "い", "を", "。", "、", "かな", "です", "AB", "？う", "！", ""]), round(at, 3), round(at + lasts, 3), rng.choice(["a", "a", "a", "b", None])))
            at += lasts * rng.choice([1, 1, 0.5])
    tokens = spark.createDataFrame(rows, "project_id bigint, tok_pos int, text string, start double, end double, speaker_id string")
    said, shown = sorted(map(tuple, utterances(tokens, style).collect()), key=lambda r: r[:2]), sorted(map(tuple, subtitles(tokens, style).collect()), key=lambda r: r[:2])
    want_said, want_shown = [], []
    for project in range(12):
        items = [{"text": r[2], "start": r[3], "end": r[4], "speaker_id": r[5]} for r in rows if r[0] == project]
        seg = Segmenter(style)
        want_said += [(project, k, u.speaker, u.start, u.end, u.text) for k, u in enumerate(seg.utterances(seg.words(items)))]
        want_shown += [(project, k, b.start, b.end, len(b.parts), seg.text_of(b)) for k, b in enumerate(seg.segmented(items))]
    assert said == want_said and shown == want_shown and len(shown) < len(said)
    spans = [(p, k, rng.randint(0, 4000), rng.randint(1, 90)) for p in range(5) for k in range(80)]
    spans = [(p, k, s, s + n) for p, k, (s, n) in ((p, k, x) for p in range(5) for k, x in enumerate(sorted((s, n) for q, _, s, n in spans if q == p)))]
    got = sorted(map(tuple, resolved(spark.createDataFrame(spans, "project_id bigint, pos int, start_ms bigint, end_ms bigint"), 20).collect()))
    want = []
    for p in range(5):
        done = Segmenter(Style(least_seconds=20)).separated([Block(s, e) for q, _, s, e in spans if q == p])
        want += [(p, k, b.start, b.end) for k, b in enumerate(done)]
    assert got == want
