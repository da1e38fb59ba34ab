"""Texts of many spans and tags take time in proportion to their length; scores of strings and patterns by a plain loop."""

import collections
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import personal_data, tool_calls
from tessera.llm.common import Scratch
from tests.llm.test_text_operators import base


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def took(run):
    start = time.time()
    out = run()
    return out, time.time() - start


def numbers(n):
    return "call " + " or ".join(f"+49 30 {1000000 + i}" for i in range(n)) + ", mail a@b.cc"


def test_personal_data_of_a_call_list(spark, scratch):
    frame = lambda n: spark.createDataFrame([(1, numbers(n))], "doc_id bigint, text string")
    personal_data.find(frame(10), scratch).collect()
    few, one = took(lambda: personal_data.find(frame(1000), scratch).collect())
    many, eight = took(lambda: personal_data.find(frame(8000), scratch).collect())
    assert len(few[0].pii_base) == 1001 and [f"{s.kind}:{s.start}:{s.end}" for s in many[0].pii_base] == base(numbers(8000))
    assert all(numbers(8000)[s.start : s.end] == s.value for s in many[0].pii_base)
    assert eight < 8 * one + 2
    clean = personal_data.redact(frame(8000), scratch).collect()[0].text
    assert clean == "call " + " or ".join(["<PHONE>"] * 8000) + ", mail <EMAIL>"


def test_pieces_cut_no_match(spark):
    """Long texts of what matches are made of: pieces are the text, start where they say, and nothing is found or lost at a cut."""
    rng = random.Random(4)
    bits = ["a@b.cc", "1.2.3.4", "4532015112830366", "4532 0151-1283 0366", "+1 (487) 555-7209", "+12", " ", " ", "-", "é", "\U0001f600", "9", "77", "word", "\n", "\t", ". ", " (", ") ", "\""]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([300, 900, 2000])))) for i in range(60)]
    got = spark.createDataFrame(rows, "doc_id bigint, text string").select("text", personal_data.pieces(F.col("text")).alias("p"), personal_data.base_spans(F.col("text")).alias("whole"), F.transform(personal_data.pieces(F.col("text")), personal_data._seen).alias("seen")).collect()
    assert max(len(r.p) for r in got) > 3
    for r in got:
        assert "".join(p.text for p in r.p) == r.text and all(r.text[p.at :].startswith(p.text) for p in r.p)
        assert sorted((s.kind, s.start, s.end) for p in r.seen for s in p.base) == sorted((s.kind, s.start, s.end) for s in r.whole)
        for p in r.p:
            assert p.before == [w for w in r.text[: p.at].lower().replace('"', " ").split() if w][-2:]


def test_scores_are_a_plain_loop(spark, scratch):
    rng = random.Random(5)
    kinds = {f"s{i}": rng.choice([(True, True), (False, True), (False, False), (False, False)]) for i in range(60)}
    pairs = {(f"p{rng.randrange(14)}", v) for v in kinds for _ in range(rng.randint(1, 4))}
    score = {v: 0.0 for v in kinds}
    behind = collections.defaultdict(set)
    for p, v in pairs:
        behind[p].add(v)
    while True:
        now = {v: max(score[v], float(kinds[v][1])) for v in kinds}
        trust = {p: sum(now[v] for v in vs) / (len(vs) + 1) for p, vs in behind.items()}
        trust = {p: t for p, t in trust.items() if sum(kinds[v][1] for v in behind[p]) >= personal_data.SUPPORT and t >= personal_data.BELIEVED}
        new = {v: 1 - math.prod(1 - trust[p] for p, w in pairs if w == v and p in trust) for v in kinds if not kinds[v][0]}
        moved = any(new[v] - score[v] >= personal_data.STABLE for v in new)
        score.update(new)
        if not moved:
            break
    frame = spark.createDataFrame([(p, v, *kinds[v]) for p, v in pairs], "pattern string, value string, base boolean, seed boolean")
    got = {r.value: r.score for r in personal_data.scores(frame, scratch).collect()}
    assert 0 < len(got) < len(kinds) and all(math.isclose(got.get(v, 0.0), new[v], abs_tol=1e-9) for v in new)


CALL = '<tool_call>{"id":"c","name":"f","arguments":{}}</tool_call>'


@pytest.mark.parametrize(
    ("text", "raws", "plain"),
    [
        ('a<tool_call>{"x":"</tool_call> and <tool_call>"}</tool_call>b', ['{"x":"</tool_call> and <tool_call>"}'], "ab"),
        ("<tool_call>cut off " + CALL, [CALL[11:-12]], "<tool_call>cut off"),
        (CALL + "<tool_call>" * 3, [CALL[11:-12]], "<tool_call>" * 3),
        ('<tool_call>{"a":"b</tool_call> c', ['{"a":"b'], "c"),
        (r'<tool_call>{"a":"\"</tool_call>\\"}</tool_call>', [r'{"a":"\"</tool_call>\\"}'], ""),
        ("</tool_call><tool_call></tool_call>", [""], "</tool_call>"),
    ],
)
def test_wrappers(spark, text, raws, plain):
    rows = tool_calls.events(spark.createDataFrame([(1, 0, "user", text)], "conv_id bigint, turn bigint, role string, text string"), "conv_id", "turn", "role", "text").collect()
    assert [r.raw for r in rows if r.kind == "call"] == raws
    assert [r.raw for r in rows if r.kind == "message"] == ([plain] if plain else [])


@pytest.mark.parametrize("piece", ["<tool_call> some text ", '<tool_call>"', r"<tool_call>\" ", '<tool_call>"x</tool_call>"', "</tool_call>", '<tool_call>{"a":"', "<tool_result><tool_call>"])
def test_broken_tags_take_linear_time(spark, piece):
    frame = lambda n: spark.createDataFrame([(1, 0, "user", piece * n)], "conv_id bigint, turn bigint, role string, text string")
    run = lambda n: tool_calls.events(frame(n), "conv_id", "turn", "role", "text").select(F.count("*"), F.sum(F.length("raw"))).collect()
    run(10)
    few, many = took(lambda: run(4000))[1], took(lambda: run(32_000))[1]
    assert many < 8 * few + 3
