"""Conversation-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import prompts as P
from shelfspark.plans import binds
from shelfspark.plans.binds import with_views
from shelfspark.plans.registry import query, table
from shelfspark.plans.sqltext import strip_markdown, sub

_BASE = "prompt_id, conversation_id, prompt_text, answer_text, user_feedback, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
_REPORT_SQL = """SELECT CAST(count(*) FILTER (WHERE user_feedback) AS BIGINT) AS positive,
    CAST(count(*) FILTER (WHERE NOT user_feedback) AS BIGINT) AS negative,
    CAST(count(*) FILTER (WHERE user_feedback IS NULL) AS BIGINT) AS no_feedback,
    CAST(count(*) AS BIGINT) AS total FROM prompts"""
_RANGE_SQL = " WHERE created_at >= DATE '2024-01-05' AND created_at < DATE '2024-01-21'"
_PARENT = """LEFT JOIN (SELECT conversation_id, user_feedback AS conversation_feedback,
    user_feedback_message AS conversation_message FROM conversations_dim) p USING (conversation_id)"""


def _text_time(df):
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("g1_feedback_report", with_views("prompts") + " " + _REPORT_SQL)
def report(spark, sf):
    return P.feedback_report(binds.prompts(spark, sf))


@query("g1_feedback_report_range", with_views("prompts") + " " + _REPORT_SQL + _RANGE_SQL)
def report_range(spark, sf):
    return P.feedback_report(binds.prompts(spark, sf), "2024-01-05", "2024-01-20")


@query(
    "g2_date_range",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type FROM events
       WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16'""",
)
def event_range(spark, sf):
    kept = P.date_range(table(spark, sf, "events"), "ts", "2024-01-10", "2024-01-15")
    return kept.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id", "event_type")


@query(
    "g3_page_prompts",
    with_views("prompts", "conversations_dim")
    + f""" SELECT {_BASE}, conversation_feedback, conversation_message, total FROM (
        SELECT * FROM (SELECT *, count(*) OVER () AS total FROM prompts{_RANGE_SQL})
        ORDER BY prompt_id DESC LIMIT 50 OFFSET 50) {_PARENT}""",
)
def page(spark, sf):
    df = P.page_prompts(
        binds.prompts(spark, sf), binds.conversations_dim(spark, sf), 50, 50, "2024-01-05", "2024-01-20"
    )
    return _text_time(df)


@query(
    "g3_page_before",
    with_views("prompts", "conversations_dim")
    + f""" SELECT {_BASE}, conversation_feedback, conversation_message, total FROM (
        SELECT * FROM (SELECT *, count(*) OVER () AS total FROM prompts{_RANGE_SQL})
        WHERE prompt_id < 6000 ORDER BY prompt_id DESC LIMIT 30) {_PARENT}""",
)
def page_before(spark, sf):
    conversations = binds.conversations_dim(spark, sf)
    return _text_time(P.page_before(binds.prompts(spark, sf), conversations, 6000, 30, "2024-01-05", "2024-01-20"))


@query(
    "g4_prompts_with_conversation",
    with_views("prompts", "conversations_dim")
    + f" SELECT {_BASE}, conversation_feedback, conversation_message FROM prompts {_PARENT} ORDER BY prompt_id DESC",
)
def with_conversation(spark, sf):
    return _text_time(P.prompts_with_conversation(binds.prompts(spark, sf), binds.conversations_dim(spark, sf)))


@query(
    "g5_nest_conversations",
    with_views("prompts", "conversations_dim")
    + """ SELECT c.conversation_id, c.length, c.user_feedback, c.user_feedback_message, CAST(0 AS BIGINT) AS part,
        CAST(count(p.prompt_id) AS BIGINT) AS n_prompts,
        coalesce(string_agg(p.prompt_id || ':' || p.prompt_text || ':' || p.answer_text, '|' ORDER BY p.prompt_id), '') AS nested
        FROM conversations_dim c LEFT JOIN prompts p ON p.conversation_id = c.conversation_id GROUP BY ALL""",
)
def nested(spark, sf):
    df = P.nest_conversations(binds.conversations_dim(spark, sf), binds.prompts(spark, sf))
    return df.select(
        "conversation_id", "length", "user_feedback", "user_feedback_message", "part",
        F.size("prompts").cast("bigint").alias("n_prompts"),
        F.array_join(
            F.transform("prompts", lambda p: F.concat_ws(":", p["prompt_id"], p["prompt_text"], p["answer_text"])), "|"
        ).alias("nested"),
    )


_UPDATES_SQL = """, updates AS (SELECT user_id AS conversation_id, CAST(floor(value) AS BIGINT) % 5 AS nth,
    CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS user_feedback,
    props AS user_feedback_message, event_id AS ord FROM events)"""
_POSITIONS_SQL = """, pos AS (SELECT prompt_id, conversation_id,
    row_number() OVER (PARTITION BY conversation_id ORDER BY prompt_id) - 1 AS nth FROM prompts)"""


def _updates(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("conversation_id"),
        (F.floor("value") % 5).cast("bigint").alias("nth"),
        F.when(kind == "purchase", True).when(kind == "error", False).alias("user_feedback"),
        F.col("props").alias("user_feedback_message"),
        F.col("event_id").alias("ord"),
    )


@query(
    "g6_set_nth_feedback",
    with_views("prompts") + _UPDATES_SQL + _POSITIONS_SQL
    + """, last AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY conversation_id, nth ORDER BY ord DESC) = 1)
       SELECT p.prompt_id, p.conversation_id, CASE WHEN u.ord IS NOT NULL THEN u.user_feedback ELSE p.user_feedback END AS user_feedback
       FROM prompts p JOIN pos USING (prompt_id)
       LEFT JOIN last u ON u.conversation_id = pos.conversation_id AND u.nth = pos.nth""",
)
def nth_feedback(spark, sf):
    updates = _updates(spark, sf).drop("user_feedback_message")
    return P.set_nth_feedback(binds.prompts(spark, sf), updates).select("prompt_id", "conversation_id", "user_feedback")


@query(
    "g6_rejected_feedback",
    with_views("prompts") + _UPDATES_SQL + _POSITIONS_SQL
    + " SELECT ord, conversation_id, nth FROM updates u WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.conversation_id = u.conversation_id AND pos.nth = u.nth)",
)
def nth_rejected(spark, sf):
    updates = _updates(spark, sf).drop("user_feedback_message")
    return P.rejected_nth_feedback(binds.prompts(spark, sf), updates).select("ord", "conversation_id", "nth")


@query(
    "g7_set_conversation_feedback",
    with_views("conversations_dim") + _UPDATES_SQL
    + """, last AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY ord DESC) = 1)
       SELECT c.conversation_id, c.length, CASE WHEN u.ord IS NULL THEN c.user_feedback ELSE u.user_feedback END AS user_feedback,
         CASE WHEN u.ord IS NULL THEN c.user_feedback_message ELSE u.user_feedback_message END AS user_feedback_message
       FROM conversations_dim c LEFT JOIN last u USING (conversation_id)""",
)
def conversation_feedback(spark, sf):
    return P.set_conversation_feedback(binds.conversations_dim(spark, sf), _updates(spark, sf).drop("nth"))


@query(
    "g8_append_prompts",
    with_views("prompts")
    + """, batch AS (SELECT event_id AS ord, CASE WHEN event_type <> 'signup' THEN user_id END AS conversation_id,
           props AS prompt_text, event_type AS answer_text FROM events),
       filled AS (SELECT conversation_id, count(*) AS n FROM prompts GROUP BY 1),
       tops AS (SELECT (SELECT max(prompt_id) FROM prompts) AS p,
           greatest((SELECT max(conversation_id) FROM prompts), (SELECT max(conversation_id) FROM batch)) AS c),
       fresh AS (SELECT ord, tops.c + row_number() OVER (ORDER BY ord) AS conversation_id FROM batch, tops WHERE conversation_id IS NULL),
       known AS (SELECT b.ord, b.conversation_id FROM batch b LEFT JOIN filled f ON f.conversation_id = b.conversation_id
           WHERE b.conversation_id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY b.conversation_id ORDER BY b.ord) + coalesce(f.n, 0) <= 10),
       accepted AS (SELECT ord, a.conversation_id, tops.p + row_number() OVER (ORDER BY ord) AS prompt_id
           FROM (SELECT * FROM fresh UNION ALL SELECT * FROM known) a, tops)
       SELECT b.ord, a.prompt_id, coalesce(a.conversation_id, b.conversation_id) AS conversation_id, b.prompt_text, b.answer_text,
           CASE WHEN a.prompt_id IS NULL THEN 'rejected' ELSE 'accepted' END AS status
       FROM batch b LEFT JOIN accepted a USING (ord)""",
)
def append(spark, sf):
    batch = table(spark, sf, "events").select(
        F.col("event_id").alias("ord"),
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("conversation_id"),
        F.col("props").alias("prompt_text"),
        F.col("event_type").alias("answer_text"),
    )
    return P.append_prompts(binds.prompts(spark, sf), batch)


@query(
    "g9_delete_prompts",
    with_views("prompts") + f" SELECT {_BASE} FROM prompts WHERE prompt_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def drop_prompts(spark, sf):
    ids = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("prompt_id"))
    return _text_time(P.delete_prompts(binds.prompts(spark, sf), ids))


@query(
    "g9_delete_conversations",
    with_views("prompts", "conversations_dim")
    + """, gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
       SELECT 'conversation' AS kind, conversation_id AS id FROM conversations_dim WHERE conversation_id NOT IN (FROM gone)
       UNION ALL SELECT 'prompt', prompt_id FROM prompts WHERE conversation_id NOT IN (FROM gone)""",
)
def drop_conversations(spark, sf):
    ids = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("conversation_id"))
    conv, left = P.delete_conversations(binds.conversations_dim(spark, sf), binds.prompts(spark, sf), ids)
    return conv.select(F.lit("conversation").alias("kind"), F.col("conversation_id").alias("id")).unionByName(
        left.select(F.lit("prompt").alias("kind"), F.col("prompt_id").alias("id"))
    )


@query(
    "g10_recent_turns",
    with_views("prompts")
    + """, last AS (SELECT * FROM prompts QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY prompt_id DESC) <= 2)
       SELECT conversation_id, string_agg(prompt_text || '>' || answer_text, '|' ORDER BY prompt_id) AS turns
       FROM last WHERE prompt_text <> '' AND answer_text <> '' GROUP BY 1""",
)
def recent(spark, sf):
    df = P.recent_turns(binds.prompts(spark, sf), 2)
    joined = F.array_join(F.transform("turns", lambda t: F.concat_ws(">", t["question"], t["answer"])), "|")
    return df.select("conversation_id", joined.alias("turns"))


@query(
    "g11_trim_messages",
    with_views("messages")
    + """ SELECT * FROM messages WHERE role = 'system' UNION ALL
       (SELECT * FROM messages WHERE role <> 'system'
        QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) <= 3)""",
)
def trim(spark, sf):
    return P.trim_messages(binds.messages(spark, sf), max_messages=3)


_SYSTEM = "Jste asistent knihovny."


@query(
    "g12_transcript",
    with_views("prompts")
    + f""" SELECT DISTINCT conversation_id, CAST(NULL AS BIGINT) AS prompt_id, 0 AS part, 'system' AS role, '{_SYSTEM}' AS content FROM prompts
       UNION ALL SELECT conversation_id, prompt_id, 1, 'user', '<user_message>' || chr(10) || prompt_text || chr(10) || '</user_message>' FROM prompts
       UNION ALL SELECT conversation_id, prompt_id, 2, 'assistant', answer_text FROM prompts""",
)
def transcript(spark, sf):
    return P.transcript(binds.prompts(spark, sf), _SYSTEM)


_ROLES_SQL = """, m AS (SELECT conversation_id, turn,
    CASE WHEN role = 'user' AND length(content) % 3 = 0 THEN 'tool' WHEN role = 'user' AND length(content) % 7 = 0 THEN 'function'
         WHEN role = 'assistant' AND length(content) % 11 = 0 THEN 'robot' ELSE role END AS role,
    role = 'assistant' AND length(content) % 2 = 0 AS has_tool_calls FROM messages)"""


@query(
    "g13_validate_messages",
    with_views("messages") + _ROLES_SQL
    + """, k AS (SELECT *, last_value(CASE WHEN role <> 'tool' THEN turn END IGNORE NULLS)
           OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt
         FROM m WHERE role <> 'function'),
       f AS (SELECT k.*, p.role AS pr, p.has_tool_calls AS pc FROM k LEFT JOIN m p ON p.conversation_id = k.conversation_id AND p.turn = k.pt),
       g AS (SELECT conversation_id, turn, role, has_tool_calls,
         CASE WHEN role NOT IN ('system', 'user', 'assistant', 'tool') THEN 'unknown_role'
              WHEN role = 'tool' AND pr IS NULL THEN 'tool_first'
              WHEN role = 'tool' AND pr <> 'assistant' THEN 'tool_after_other_role'
              WHEN role = 'tool' AND NOT pc THEN 'tool_without_call' END AS problem FROM f)
       SELECT *, problem IS NULL AS valid FROM g""",
)
def validate(spark, sf):
    role, n = F.col("role"), F.length("content")
    mixed = binds.messages(spark, sf).select(
        "conversation_id",
        "turn",
        F.when((role == "user") & (n % 3 == 0), "tool")
        .when((role == "user") & (n % 7 == 0), "function")
        .when((role == "assistant") & (n % 11 == 0), "robot")
        .otherwise(role)
        .alias("role"),
        ((role == "assistant") & (n % 2 == 0)).alias("has_tool_calls"),
    )
    return P.validate_messages(mixed)


@query("g14_conversation_ids", with_views("prompts") + " SELECT DISTINCT conversation_id FROM prompts ORDER BY 1 DESC")
def ids(spark, sf):
    return P.conversation_ids(binds.prompts(spark, sf))


@query("g14_by_conversation", with_views("prompts") + f" SELECT {_BASE} FROM prompts WHERE conversation_id = 7")
def one_conversation(spark, sf):
    return _text_time(P.by_conversation(binds.prompts(spark, sf), 7))


def _flat_sql(x: str) -> str:
    return sub(sub(strip_markdown(f"coalesce({x}, '')"), r"\r?\n", " "), r"\s{2,}", " ")


@query(
    "g15_export_prompts",
    with_views("prompts", "conversations_dim")
    + f""" SELECT CAST(prompt_id AS VARCHAR) AS "promptId", CAST(conversation_id AS VARCHAR) AS "conversationId",
      {_flat_sql("prompt_text")} AS "promptText", {_flat_sql("answer_text")} AS "answerText",
      CASE WHEN user_feedback THEN 'true' WHEN NOT user_feedback THEN 'false' ELSE '' END AS "userFeedback",
      CASE WHEN conversation_feedback THEN 'positive' WHEN NOT conversation_feedback THEN 'negative' ELSE '' END AS "convoFeedback",
      {_flat_sql("conversation_message")} AS "convoFeedbackMessage" FROM prompts {_PARENT}""",
)
def export(spark, sf):
    return P.export_rows(binds.prompts(spark, sf), binds.conversations_dim(spark, sf))
