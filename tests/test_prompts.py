from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfspark.operators import prompts as P
from shelfspark.operators import skew
from shelfspark.session import scratch_path

PROMPT = "prompt_id long, prompt_text string, answer_text string, conversation_id long, user_feedback boolean, created_at timestamp"
CONVERSATION = "conversation_id long, length int, user_feedback boolean, user_feedback_message string"


def prompts(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [
        (1, "q1", "a1", 10, True, day), (2, "q2", "", 10, None, day + dt.timedelta(hours=23, minutes=59, seconds=59, microseconds=999000)),
        (3, "q3", "a3", 20, False, day + dt.timedelta(days=1)), (4, "q4", "a4", 10, None, day + dt.timedelta(days=2)),
    ]
    return spark.createDataFrame(rows, PROMPT)


def conversations(spark):
    return spark.createDataFrame([(10, 0, True, "m, \"x\""), (20, 0, None, None), (30, 0, False, None)], CONVERSATION)


def test_report_counts_null_as_no_feedback_and_ranges_are_inclusive(spark):
    assert P.feedback_report(prompts(spark)).first().asDict() == {"positive": 1, "negative": 1, "no_feedback": 2, "total": 4}
    assert P.feedback_report(prompts(spark), "2024-01-01", "2024-01-01").first()["total"] == 2
    assert P.feedback_report(prompts(spark), date_from="2024-01-02").first()["total"] == 2
    assert P.feedback_report(prompts(spark), date_to="2023-12-31").first()["total"] == 0


def test_nested_conversations_keep_empty_ones_and_split_long_ones(spark):
    got = {r["conversation_id"]: [p["prompt_id"] for p in r["prompts"]] for r in P.nest_conversations(conversations(spark), prompts(spark)).collect()}
    assert got == {10: [1, 2, 4], 20: [3], 30: []}
    parts = P.nest_conversations(conversations(spark), prompts(spark), 10, part_size=2).orderBy("part").collect()
    assert [[p["prompt_id"] for p in r["prompts"]] for r in parts] == [[1, 2], [4]]


def test_nth_feedback_last_update_wins_and_unknown_is_rejected(spark):
    updates = spark.createDataFrame([(10, 1, True, 1), (10, 1, False, 2), (10, 0, None, 3), (20, 5, True, 4), (99, 0, True, 5)], "conversation_id long, nth long, user_feedback boolean, ord long")
    got = {r["prompt_id"]: r["user_feedback"] for r in P.set_nth_feedback(prompts(spark), updates).collect()}
    assert got == {1: None, 2: False, 3: False, 4: None}
    assert sorted(r["ord"] for r in P.rejected_nth_feedback(prompts(spark), updates).collect()) == [4, 5]


def test_conversation_feedback_stores_the_message(spark):
    updates = spark.createDataFrame([(20, True, "ano", 1), (20, False, "ne", 2)], "conversation_id long, user_feedback boolean, user_feedback_message string, ord long")
    got = {r["conversation_id"]: (r["user_feedback"], r["user_feedback_message"]) for r in P.set_conversation_feedback(conversations(spark), updates).collect()}
    assert got[20] == (False, "ne") and got[30] == (False, None)


def test_append_caps_and_numbers(spark):
    batch = spark.createDataFrame([(1, 10, "x", "y"), (2, None, "x", "y"), (3, 10, "x", "y"), (4, None, "x", "y"), (5, 20, "x", "y")], "ord long, conversation_id long, prompt_text string, answer_text string")
    got = {r["ord"]: (r["status"], r["conversation_id"], r["prompt_id"]) for r in P.append_prompts(prompts(spark), batch, cap=4).collect()}
    assert got == {1: ("accepted", 10, 5), 2: ("accepted", 21, 6), 3: ("rejected", 10, None), 4: ("accepted", 22, 7), 5: ("accepted", 20, 8)}


def test_delete_cascades(spark):
    gone = spark.createDataFrame([(10,)], "conversation_id long")
    conv, left = P.delete_conversations(conversations(spark), prompts(spark), gone)
    assert {r[0] for r in conv.select("conversation_id").collect()} == {20, 30}
    assert [r["prompt_id"] for r in left.collect()] == [3]


def test_recent_turns_cut_before_dropping_unanswered(spark):
    got = {r["conversation_id"]: [t["question"] for t in r["turns"]] for r in P.recent_turns(prompts(spark), 2).collect()}
    assert got == {10: ["q4"], 20: ["q3"]}


def test_transcript_order_and_wrapping(spark):
    rows = P.transcript(prompts(spark).filter("conversation_id = 10"), "sys").orderBy(F.col("prompt_id").asc_nulls_first(), "part").collect()
    assert [r["role"] for r in rows] == ["system"] + ["user", "assistant"] * 3
    assert rows[1]["content"] == "<user_message>\nq1\n</user_message>"


def test_message_validation(spark):
    rows = [
        (1, 0, "tool", False), (1, 1, "assistant", True), (1, 2, "tool", False), (1, 3, "tool", False), (1, 4, "user", False), (1, 5, "tool", False),
        (1, 6, "assistant", False), (1, 7, "tool", False), (1, 8, "function", False), (1, 9, "robot", False),
    ]
    df = spark.createDataFrame(rows, "conversation_id long, turn long, role string, has_tool_calls boolean")
    got = {r["turn"]: r["problem"] for r in P.validate_messages(df).collect()}
    assert got == {0: "tool_first", 1: None, 2: None, 3: None, 4: None, 5: "tool_after_other_role", 6: None, 7: "tool_without_call", 9: "unknown_role"}


def test_trim_keeps_system_rows(spark):
    rows = [(1, i, "system" if i == 0 else "user", str(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "conversation_id long, turn long, role string, content string")
    assert sorted(r["turn"] for r in P.trim_messages(df, 2).collect()) == [0, 4, 5]
    assert sorted(r["turn"] for r in P.trim_messages(df, 50, last_n=1).collect()) == [0, 5]


def test_null_roles_and_conversations_stay(spark, monkeypatch):
    rows = [(None, 0, "assistant", True), (None, 1001, "tool", None), (1, 0, None, None), (1, 1, "tool", None), (1, 2, "assistant", None), (1, 3, "tool", None)]
    df = spark.createDataFrame(rows, "conversation_id long, turn long, role string, has_tool_calls boolean")
    want = {
        (None, 0): None, (None, 1001): None, (1, 0): "unknown_role", (1, 1): "tool_after_other_role", (1, 2): None, (1, 3): "tool_without_call",
    }
    for most in (skew.MAX_GROUP_ROWS, 0):
        monkeypatch.setattr(skew.carry_forward, "__defaults__", (most, 1))
        got = {(r["conversation_id"], r["turn"]): r["problem"] for r in P.validate_messages(df).collect()}
        assert got == want
    kept = P.trim_messages(df.withColumn("content", F.lit("c")), 1).collect()
    assert sorted(str((r["conversation_id"], r["turn"])) for r in kept) == ["(1, 3)", "(None, 1001)"]
    assert P.trim_messages(df, 10).count() == len(rows)


def test_deep_pages_and_pages_before_an_id(spark, monkeypatch):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-50, 10**7), 400))
    p = spark.createDataFrame([(i, "q", "a", i % 7, True, dt.datetime(2024, 1, 1)) for i in ids], PROMPT)
    c = spark.createDataFrame([(k, 0, True, "m") for k in range(7)], CONVERSATION)
    newest = ids[::-1]
    for most in (10**6, 0):
        monkeypatch.setattr(P, "DEEP_OFFSET", most)
        for offset in (1, 39, 395, 399, 400, 10**6):
            page = P.page_prompts(p, c, offset, 10).collect()
            assert sorted((r["prompt_id"] for r in page), reverse=True) == newest[offset : offset + 10]
            assert {r["total"] for r in page} <= {400}
    for bins in (2, 5, 1024):
        assert [P.id_at_rank(p, "prompt_id", k, bins)[0] for k in (0, 7, 399)] == [newest[0], newest[7], newest[399]]
    repeated = spark.createDataFrame([(5,), (5,), (5,), (9,), (None,)], "prompt_id long")
    assert [P.id_at_rank(repeated, "prompt_id", k) for k in range(5)] == [(9, 0), (5, 1), (5, 1), (5, 1), None]
    before, seen = None, []
    while rows := P.page_before(p, c, before, 90).collect():
        seen += sorted((r["prompt_id"] for r in rows), reverse=True)
        before = seen[-1]
    assert seen == newest


def test_export_file_has_mark_header_and_quotes(spark):
    path = scratch_path(spark, "export")
    P.export_prompts(prompts(spark), conversations(spark), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).orderBy("path").collect()
    texts = [bytes(f["content"]).decode("utf-8").splitlines() for f in files]
    header = "\ufeffpromptId,conversationId,promptText,answerText,userFeedback,convoFeedback,convoFeedbackMessage"
    assert {t[0] for t in texts} == {header}
    lines = [line for t in texts for line in t[1:]]
    assert [line.split(",")[0] for line in lines] == ["4", "3", "2", "1"]
    assert lines[0] == '4,10,q4,a4,,positive,"m, ""x"""'
    assert lines[3] == '1,10,q1,a1,true,positive,"m, ""x"""'
