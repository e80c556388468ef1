"""Cases of the repair, finalising, sampling, call and project operators."""

import itertools
import json
import random
import re

import pytest
from cuewright.functions.text import HAN_OR_KANA, name_spacer, without_terms
from cuewright.operators import calls, finalize, projects, repair, samples
from pyspark.sql import functions as F

ROWS = "chunk int, pos int, timecode string, text string"


def streams(spark, *chunks):
    """Source and output from (source codes, output codes) of each chunk; an output's text is its code and place."""
    source = [(c, k, t, None) for c, (s, _) in enumerate(chunks) for k, t in enumerate(s)]
    output = [(c, k, t, f"{t}{k}") for c, (_, o) in enumerate(chunks) for k, t in enumerate(o)]
    return spark.createDataFrame(source, ROWS).drop("text"), spark.createDataFrame(output, ROWS)


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["chunk"], r["pos"])):
        out.setdefault((r["chunk"], r[-1]), []).append(r["text"])
    return out


def test_chain_takes_the_first_answer(spark):
    source, output = streams(spark, ("abc", "abc"), ("abc", "xbc"), ("abcd", "a"), ("abcde", "axcd"), ("abcdef", "xyz"), ("abcdef", "xy"), ("abc", ""))
    got = repair.repaired(source, output, 1)
    assert told(got) == {(0, "as it is"): ["a0", "b1", "c2"], (1, "position"): ["x0", "b1", "c2"], (2, "subset"): ["a0", "", "", ""], (3, "anchors"): ["a0", "x1", "c2", "d3", ""]}
    assert sorted((r["chunk"], r["error"].split(";")[0]) for r in repair.unresolved(source, output, 1, got).collect()) == [
        (4, "Unexpected output timecode 'x'"), (5, "Unexpected output timecode 'x'"), (6, "Missing 3 source block(s) exceeds tolerance 1")]
    pairs = spark.createDataFrame([(4, 0, 0, 1), (4, 1, 2, 5), (5, 0, 0, 1), (5, 1, 1, 1), (0, 0, 0, 2)], "chunk int, at int, output_pos int, source_pos int")
    mapped = told(repair.repaired(source, output, 1, pairs))
    assert mapped[4, "mapping"] == ["", "x0", "", "", "", "z2"] and (5, "mapping") not in mapped and mapped[0, "as it is"] == ["a0", "b1", "c2"]


def test_repair_loop(spark):
    source, output = streams(spark, ("abc", "abc"), ("abcdef", "xyz"), ("abcdef", "uvw"), ("abcdef", "pq"))
    asked, waits = [], []

    def ask(prompts):
        rows = prompts.collect()
        asked.append({r["chunk"]: r["prompt"] for r in rows})
        answers = {1: [(1, 1), (3, 6)], 2: [(1, 1), (2, 1)] if len(asked) == 1 else [(2, 4)]}
        raw = [(r["chunk"], json.dumps({"assignments": [{"output_index": o, "source_index": s} for o, s in answers[r["chunk"]]]}) if r["chunk"] in answers else "sorry", 0.5) for r in rows]
        return spark.createDataFrame(raw, "chunk int, raw string, cost double")

    rows, costs, failures = repair.repair_loop(source, output, 1, ask, attempts=3, wait=waits.append)
    assert told(rows) == {(1, 1): ["x0", "", "", "", "", "z2"], (2, 2): ["", "", "", "v1", "", ""]}
    assert {(r["chunk"], r["cost"], r["attempts"]) for r in costs.collect()} == {(1, 0.5, 1), (2, 1.0, 2), (3, 1.5, 3)}
    assert [(r["chunk"], r["error"]) for r in failures.collect()] == [(3, "Fix response must contain an assignments array")]
    assert [sorted(a) for a in asked] == [[1, 2, 3], [2, 3], [3]] and waits == [1, 2]
    assert asked[0][1].startswith("Unexpected output timecode 'x'") and "\n---\n1\na\n" in asked[0][1] and asked[0][1].endswith("3\nz\nz2\n")


def test_calls(spark):
    value = lambda column, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(column.alias("x")).first()["x"]
    count = lambda text: value(calls.request_count(calls.envelope(F.col("t"))), t=text)
    assert count('{"stats": {"models": {"a": {"api": {"totalRequests": 3}}, "b": {"api": {"totalRequests": 4}}}}, "totalRequests": 9}') == 7
    assert count('noise {"deep": [{"totalRequests": 5}, {"totalRequests": "6"}]} end') == 5 and count('{"a": 1}') == 1 and count('{"totalRequests": 0}') == 1
    with pytest.raises(Exception, match="Could not parse"):
        count("no braces")
    quota = lambda code, message: spark.createDataFrame([(code, message)], "c int, m string").select(calls.is_quota_error(F.col("c"), F.col("m")).alias("x")).first()["x"]
    assert quota(429, "x") and quota(None, "Quota exceeded") and quota(5, "RESOURCE_EXHAUSTED") and not quota(500, "broken") and not quota(None, "x")
    assert value(calls.tail_lines(F.col("t"), 2), t="a\nb\nc") == "b\nc" and value(calls.tail_lines(F.col("t"), 9), t="a\nb") == "a\nb"
    assert [repair.backoff_seconds(k) for k in (1, 2, 3)] == [1, 2, 4]


def test_samples(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 20_000), (1, 1, 20_000, 30_500), (2, 0, 0, 3000)], "p int, chunk int, start_ms bigint, end_ms bigint")
    got = {}
    for r in samples.chunk_samples(chunks, ["p"], 10_000, 5000).collect():
        got.setdefault((r["p"], r["chunk"]), []).append(r["at_ms"])
    assert got == {(1, 0): [5000, 10_000, 20_000], (1, 1): [20_000, 30_000, 30_500], (2, 0): [3000]}
    window = lambda n: spark.range(1).select(*[c.alias(k) for c, k in zip(samples.whole_window(F.lit(n).cast("bigint"), 5000), "ab")]).first()
    assert tuple(window(60_000)) == (5000, 58_500) and tuple(window(3000)) == (1500, 1500) and tuple(window(100)) == (0, 0)


def test_projects(spark):
    files = lambda *names: spark.createDataFrame([(1, n) for n in names], "noise int, name string")
    states = spark.createDataFrame([(1, 5)], "noise int, next_index int")
    chosen, after = projects.cyclic_choice(projects.prepared(files("000.mp4", "001.mp4", "002.mp4", "x.mp4", "01.mp4"), "noise", "name"), states, "noise", 2)
    assert sorted((r["turn"], r["name"]) for r in chosen.collect()) == [(0, "002.mp4"), (1, "000.mp4")]
    assert [tuple(r) for r in projects.saved(states, after, "noise").collect()] == [(1, 1)]
    with pytest.raises(Exception, match="run on from 000"):
        projects.prepared(files("000.mp4", "002.mp4"), "noise", "name").collect()
    with pytest.raises(Exception, match="at least 3 chunks"):
        projects.cyclic_choice(projects.prepared(files("000.mp4"), "noise", "name"), states, "noise", 3)[0].collect()
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id int, parent int")
    raw = spark.createDataFrame([(1, "{}")], "id int, raw string")
    assert sorted((r["id"], r["briefing"]) for r in projects.parent_briefings(rows.where("id < 3"), raw).collect()) == [(1, None), (2, "{}")]
    with pytest.raises(Exception, match="no briefing of the parent 9"):
        projects.parent_briefings(rows, raw).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([("{bad",)], "raw string").select(projects.briefing(F.col("raw"))).collect()


def test_suspect_lists_and_terms(spark):
    blocks = spark.createDataFrame([("p", 1, 8, "b\n c "), ("p", 0, 7, "a")], "project_id string, pos int, index int, text string")
    assert finalize.suspect_list(blocks).first()["listing"] == "- #7: a\n- #8: b  c"
    assert without_terms("水川Katamari水川Katamari", ["水川Katamari"]) == "" and without_terms("the theme the", ["the"]) == " theme "
    assert without_terms("x Long Coat Daddy y", ["Long Coat Daddy", "Coat"]) == "x  y"


def test_spacer_equals_its_rule_on_the_whole_line():
    """The rule as it is stated: blanks may stand inside a name, edges look at the line as it was."""
    units = ["AB", "A 漢", "Two Tr", "Tr", "b C", "AB漢"]
    squashed = lambda u: u.replace(" ", "").replace("\t", "")
    ordered = sorted(units, key=lambda u: (-len(u), u))
    finder = re.compile("[ \t]*(" + "|".join("[ \t]*".join(map(re.escape, squashed(u))) for u in ordered) + ")[ \t]*")

    def beside(ch, blank):
        return " " if ch and (re.match(f"[{HAN_OR_KANA}]", ch) or blank and ch.isalnum()) else ""

    def rule(line):
        def one(m):
            whole = m.group()
            left = beside(line[m.start() - 1] if m.start() else "", whole[0] in " \t")
            return left + next(u for u in ordered if squashed(u) == squashed(m[1])) + beside(line[m.end() : m.end() + 1], whole[-1] in " \t")

        return finder.sub(one, line)

    space, rng = name_spacer(units), random.Random(1)
    for k in itertools.count():
        if k == 30_000:
            break
        line = "".join(rng.choices(["A", "B", "漢", "か", "Two", "Tr", " ", "\t", "b", "C", "，", "1", "x"], k=rng.randint(0, 9)))
        assert space(line) == rule(line), line


def test_settings(spark):
    from cuewright.settings import Settings, lines_of

    told = lines_of("# a remark\nCUEWRIGHT_CHUNK_CHAR_LIMIT=1200\nexport cuewright_enable_srt_refine = 'Yes'\n\nOTHER=1\nCUEWRIGHT_UNKNOWN=2\nCUEWRIGHT_INTRO_SKIP_SECONDS=0.5")
    found = Settings.read(told)
    assert (found.chunk_char_limit, found.enable_srt_refine, found.intro_skip_seconds, found.concurrency) == (1200, True, 0.5, 10)
    assert found.stages_without() == ["glossary_checked", "cover_generated"] and Settings.read({}) == Settings()
    for bad in ({"CUEWRIGHT_CONCURRENCY": "many"}, {"CUEWRIGHT_ENABLE_SRT_REFINE": "maybe"}):
        with pytest.raises(ValueError):
            Settings.read(bad)
    spark.conf.set("cuewright.missing_block_tolerance", "5")
    try:
        assert Settings.of(spark).missing_block_tolerance == 5
    finally:
        spark.conf.unset("cuewright.missing_block_tolerance")
    assert Settings.of(spark) == Settings()
