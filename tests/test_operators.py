"""Cases of the alignment, chunking, glossary, payload, range and SRT operators."""

import json

import pytest
from cuewright.operators import align, chunking, costs, glossary, payloads, ranges
from cuewright.sources import srt
from pyspark.sql import functions as F


def stream(spark, codes, texts=None):
    rows = [(1, k, c, t) for k, (c, t) in enumerate(zip(codes, texts or [""] * len(codes)))]
    return spark.createDataFrame(rows, "chunk int, pos int, timecode string, text string")


def texts(df):
    return [r["text"] for r in sorted(df.collect(), key=lambda r: r["pos"])]


def test_repairs(spark):
    source = stream(spark, "abcd").drop("text")
    assert texts(align.by_position(source, stream(spark, "wxyz", "1234"))) == list("1234")
    assert texts(align.by_position(source, stream(spark, "abc", "123"))) == []
    assert texts(align.by_timecode_subset(source, stream(spark, "ac", "13"))) == ["1", "", "3", ""]
    assert texts(align.by_timecode_subset(source, stream(spark, "aq", "13"))) == []  # foreign
    assert texts(align.by_timecode_subset(source, stream(spark, "aa", "13"))) == []  # repeated
    assert texts(align.by_timecode_subset(source, stream(spark, "abcd", "1234"))) == []  # full
    assert texts(align.by_anchors(source, stream(spark, "axd", "124"), 2)) == ["1", "2", "", "4"]
    assert texts(align.by_anchors(stream(spark, "abcdef").drop("text"), stream(spark, "af", "16"), 2)) == []  # too wide
    assert texts(align.by_anchors(source, stream(spark, "xyz", "123"), 2)) == []  # no anchor
    assert texts(align.by_anchors(source, stream(spark, "abcd", "1234"), 2)) == []  # nothing changes
    # sources 0, 3, 1, 2: each anchor is compared with the raw one before it, which keeps 0, 3, 2
    assert texts(align.by_anchors(source, stream(spark, "adbc", "1423"), 5)) == ["1", "", "3", "4"]
    pairs = "chunk int, at int, output_pos int, source_pos int"
    mapping = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 1, 0)], pairs)
    assert texts(align.by_mapping(source, stream(spark, "xy", "12"), mapping)) == ["2", "", "1", ""]
    twice, foreign = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 1, 2)], pairs), spark.createDataFrame([(1, 0, 0, 2), (1, 1, 9, 9), (1, 2, 1, 2)], pairs)
    for wrong, said in ((twice, "Duplicate assignment for source index 2"), (foreign, "Invalid block assignment output_index=9, source_index=9")):
        assert texts(align.by_mapping(source, stream(spark, "xy", "12"), wrong)) == []
        assert [r["error"] for r in align.mapping_errors(source, stream(spark, "xy", "12"), wrong).collect()] == [said]
    assert texts(align.by_mapping(source, stream(spark, "xy", "12"), mapping.limit(0), source)) == ["", "", "", ""]
    repeated = stream(spark, "aab").drop("text")
    assert texts(align.by_timecode_subset(repeated, stream(spark, "ab", "12"))) == ["1", "1", "2"]


def test_validation(spark):
    got = align.problems(stream(spark, "abcd").drop("text"), stream(spark, "abbx", "1234"), 2).first()
    assert (got["missing"], got["unexpected"], got["duplicated"], got["delta"], got["ok"]) == (2, 1, 1, 0, False)
    assert got["errors"] == "Unexpected output timecode 'x'; Duplicate output timecodes: 'b'"
    repeated = align.problems(stream(spark, "aab").drop("text"), stream(spark, "ab", "12"), 0).first()
    assert (repeated["missing"], repeated["delta"]) == (0, 1) and repeated["errors"] == "Output block count delta 1 exceeds tolerance 0 (output 2 vs input 3)"
    nothing = align.problems(stream(spark, "abc").drop("text"), stream(spark, "a").limit(0), 1).first()
    assert nothing["errors"] == "Missing 3 source block(s) exceeds tolerance 1; Output block count delta 3 exceeds tolerance 1 (output 0 vs input 3)"
    assert align.problems(stream(spark, "abc").drop("text"), stream(spark, "ab"), 1).first()["ok"]
    one = stream(spark, "ab", "12").withColumn("index", F.col("pos") + 1)
    other = stream(spark, "axc", ["1", " ", "3"]).withColumn("index", F.col("pos") + F.when(F.col("pos") == 0, 5).otherwise(1))
    assert {(r["pos"], r["error"]) for r in align.structural_errors(one, other).collect()} == {(0, "index"), (1, "timecode"), (1, "empty"), (-1, "count")}


def fold(sizes, limit):
    n = max(1, -(-sum(sizes) // limit))
    if n >= len(sizes):
        return list(range(len(sizes)))
    out, held, closed = [], 0, 0
    for size in sizes:
        out.append(closed)
        held += size
        if held * n >= sum(sizes) and closed < n - 1:
            held, closed = 0, closed + 1
    return out


@pytest.mark.parametrize("sizes, limit", [([5], 10), ([5, 5], 1), ([10, 10, 10, 10], 20), ([1, 2, 3, 4, 5, 6, 7, 8, 9], 15), ([7] * 50, 33)])
def test_chunks(spark, sizes, limit):
    rows = spark.createDataFrame([("p", k, s) for k, s in enumerate(sizes)], "key string, pos int, size int")
    got = sorted((r["pos"], r["chunk"]) for r in chunking.chunk_numbers(rows, "key", "pos", "size", limit).collect())
    assert [c for _, c in got] == fold(sizes, limit)
    with pytest.raises(ValueError):
        chunking.chunk_numbers(rows, "key", "pos", "size", 0)


@pytest.mark.parametrize("most", [100_000, 3])
def test_hits_of_folded_names(spark, monkeypatch, most):
    monkeypatch.setattr(glossary, "SHORT", most)
    names = ["ミキ", "ＡＢＣ 放送局", "Grand Blue Fantasy", "・・", None, "", "x", "Straße", "abcdefgh"]
    aliases = spark.createDataFrame(list(enumerate(names)), "entry_id int, alias string")
    hays = ["みきです", "abc放送局。", "ＧＲＡＮＤ・ｂｌｕｅ fan tasy!", "・・", None, "", "X", "in der STRASSE", "abc defg", "ABC DEF GHI"]
    got = glossary.alias_hits(spark.createDataFrame(list(enumerate(hays)), "text_id int, hay string"), aliases).collect()
    assert sorted((r["text_id"], r["entry_id"]) for r in got) == [(0, 0), (1, 1), (2, 2), (6, 6), (7, 7), (9, 8)]
    nothing = glossary.alias_hits(spark.createDataFrame([(1, "x")], "text_id int, hay string"), aliases.where("alias = '・・'"))
    assert nothing.columns == ["text_id", "entry_id"] and nothing.count() == 0


def test_glossary(spark):
    raw = {
        "talents": [
            {"group": {"jp": ["Big Red Dog", "brd"], "zh": "大紅狗"}, "members": [{"jp": ["Ann"], "zh": "安"}, {"jp": [], "zh": "x"}]},
            {"group": {"jp": [""], "zh": "壞"}, "members": [{"jp": ["Solo One Name"], "zh": "獨"}]},
            {"members": []},
        ],
        "others": [{"jp": ["Show"], "zh": "秀"}, {"jp": ["t"], "zh": ""}],
    }
    rows = payloads.glossary_entries(spark.createDataFrame([("Here: " + json.dumps(raw),), ("nothing",)], "value string"))
    got = sorted((r["kind"], r["unit_id"], r["entry_pos"], r["is_group"], r["target"]) for r in rows.collect() if r["kind"] == "talent")
    assert got == [("talent", 0, 0, True, "大紅狗"), ("talent", 0, 1, False, "安"), ("talent", 1, 0, False, "獨")]
    assert [r["target"] for r in rows.where("kind = 'other'").collect()] == ["秀"]
    texts_ = spark.createDataFrame([(1, "the Big Red Dogs"), (2, "a Show."), (3, "Big Red"), (4, "x Solo One Name y")], "text_id int, hay string")
    aliases = spark.createDataFrame([(10, 0, "Big Red Dog"), (11, 0, "Ann"), (12, 1, "Solo One Name"), (13, None, "Show"), (14, None, "")], "entry_id int, unit_id int, alias string")
    hits = glossary.alias_hits(texts_, aliases.select("entry_id", "alias"))
    assert {tuple(r) for r in hits.collect()} == {(1, 10), (2, 13), (4, 12)}
    units = glossary.whole_units(aliases, hits)
    assert {(r["text_id"], r["entry_id"]) for r in units.collect()} == {(1, 10), (1, 11), (4, 12), (2, 13)}


def test_payloads(spark):
    casts = json.dumps({"casts": ["x", "■ Host", "Ann", "Bob", "■", "Cy", " "]})
    got = payloads.cast_rows(spark.createDataFrame([(1, casts)], "key int, raw string"), "key", "raw").collect()
    assert {r["id"] for r in got} == {f"abema:1:{k}" for k in range(1, 5)}
    assert sorted((r["nth"], r["name"], r["role"]) for r in got) == [(1, "x", None), (2, "Ann", "Host"), (3, "Bob", "Host"), (4, "Cy", None)]
    talents = json.dumps({"talents": [{"id": "1", "name": "n", "genre1": "a", "genre2": "", "genre3": "c"}, {"name": "no id"}]})
    row = payloads.talent_rows(spark.createDataFrame([(talents,)], "raw string"), "raw").collect()
    assert [(r["id"], r["roles"]) for r in row] == [("1", ["a", "c"])]
    brief = json.dumps({"proper_nouns": {"a": "A1"}, "characters": [{"name_zh": "B1"}, {}], "glossary": {"c": "C1"}})
    assert {r["unit"] for r in payloads.name_targets(spark.createDataFrame([(brief,), ("bad",)], "raw string"), "raw").collect()} == {"A1", "B1", "C1"}


def test_mapping_responses(spark):
    good = json.dumps({"assignments": [{"output_index": 2, "source_index": 1}, {"output_index": 1, "source_index": 3}]})
    row = lambda raw: spark.createDataFrame([(1, raw)], "chunk int, raw string")
    assert [tuple(r) for r in payloads.mapping_rows(row("```json\n" + good + "\n```"), "chunk", "raw").collect()] == [(1, 0, 2, 1), (1, 1, 1, 3)]
    for bad in ('{"assignments": 3}', "no json", '{"assignments": [{"output_index": 1}]}'):
        with pytest.raises(Exception, match="Fix response|Each assignment"):
            payloads.mapping_rows(row(bad), "chunk", "raw").collect()


def test_costs(spark):
    calls = spark.createDataFrame([("gemini-3-flash-preview", 1_000_000, 400_000, 100_000, 50_000), ("gemini-3-flash-preview", 10, None, None, None), ("x", 5, 5, 5, 5)], "model string, p long, c long, o long, t long")
    prices = tuple(F.col(f"p_{k}") for k in ("in", "hit", "out"))
    got = costs.priced(calls, "model").select(costs.token_cost(F.col("p"), F.col("c"), F.col("o"), F.col("t"), prices).alias("usd")).collect()
    assert sorted(r["usd"] for r in got) == pytest.approx([0, 5e-6, 0.6 * 0.5 + 0.4 * 0.1 + 0.15 * 3])
    events = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 0.0)], "project int, service string, amount double")
    assert {tuple(r) for r in costs.ledger(events, "project", "service", "amount").collect()} == {(1, "a", 1.0), (1, "b", 2.0), (1, None, 3.0), (None, None, 3.0)}
    for bad, said in (((1, "a", -1.0), "negative"), ((1, " ", 1.0), "without a service"), ((1, None, 1.0), "without a service")):
        with pytest.raises(Exception, match=said):
            costs.ledger(spark.createDataFrame([bad], events.schema), "project", "service", "amount").collect()
    payload = lambda p: spark.createDataFrame([(p,)], "p string").select(costs.speech_seconds(F.from_json("p", payloads.ASR)["audio_duration_secs"], payloads.word_items(F.col("p"))).alias("s")).first()["s"]
    assert payload('{"audio_duration_secs": 4, "words": [{"end": 9}]}') == 4 and payload('{"audio_duration_secs": -4}') == 0
    assert payload('{"words": [{"end": 3}, {"end": 9}, {"end": null}]}') == 9 and payload('{"transcripts": [{"words": [{"end": 2.5}]}]}') == 2.5 and payload("{}") == 0


def test_stages(spark):
    stages = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "stage_ord int, stage string")
    done = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "c"), (4, "b")], "key int, stage string")
    keys = spark.createDataFrame([(k,) for k in range(1, 5)], "key int")
    due = lambda *a, **k: {tuple(r) for r in ranges.next_stages(stages, done, "key", *a, **k).collect()}
    assert due() == {(1, 1, "b"), (4, 0, "a")} and due(keys) == {(1, 1, "b"), (3, 0, "a"), (4, 0, "a")}
    skipped = spark.createDataFrame([(1, "b"), (4, "a")], "key int, stage string")
    assert due(keys, skipped) == {(1, 2, "c"), (3, 0, "a"), (4, 2, "c")}
    assert due(keys, skipped, "b") == {(3, 0, "a")}


def test_ranges(spark):
    one = spark.range(1)
    lattice = lambda a, b, step, s, e: one.select(ranges.lattice(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), step, s, e).alias("x")).first()["x"]
    assert lattice(61, 180, 60, True, False) == [61, 120] and lattice(120, 180, 60, True, True) == [120, 180] and lattice(1, 50, 60, False, False) == []
    rows = spark.createDataFrame([(1, 10, 30, 0, 100), (1, 35, 70, 1, 100), (1, 80, 100, 2, 100), (2, 0, 40, 0, 100), (2, 40, 100, 1, 100)], "key int, start_ms int, end_ms int, pos int, duration int")
    assert {tuple(r) for r in ranges.split_points(rows, "key", "duration").collect()} == {(1, 32.5), (2, 40.0)}
    items = spark.range(5).withColumnRenamed("id", "n")
    assert sorted((r["turn"], r["n"]) for r in ranges.cyclic(items, "n", 5, 3, 3).collect()) == [(0, 3), (1, 4), (2, 0)]
    assert one.select(costs.speech_cost(F.lit(3600.0)).alias("c")).first()["c"] == pytest.approx(0.22)


def test_srt(spark):
    document = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHi\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\na\r\nb\r\n\r\nlonely"
    docs = spark.createDataFrame([("p", document)], "project_id string, document string")
    got = [(r["index"], r["start_ms"], r["end_ms"], r["text"]) for r in srt.parse(docs).collect()]
    assert got == [(1, 1000, 2500, "Hi"), (2, 3000, 4000, "a\nb")]
    with pytest.raises(Exception, match="not a timecode"):
        srt.parse(spark.createDataFrame([("p", "1\n00:00:01 --> x\nHi")], "project_id string, document string")).collect()
    broken = "x\n0:0:1,5 --> 0:0:2,5\nHi\n\nno time\nat all\n\n9\n00:00:03,000 --> 00:00:04,000"
    loose = srt.parse_lenient(spark.createDataFrame([("p", broken)], "project_id string, document string"), first=5).collect()
    assert [(r["index"], r["timecode"], r["text"]) for r in loose] == [(5, "0:0:1,5 --> 0:0:2,5", "Hi"), (6, srt.ZERO, "no time\nat all"), (7, "00:00:03,000 --> 00:00:04,000", "")]
    blocks = srt.parse(docs)
    again = srt.parse(srt.serialize(blocks))
    assert again.drop("pos").collect() == blocks.drop("pos").collect()
    assert srt.ass_documents(blocks).first()["document"].endswith("Dialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,a\\Nb\n")
