"""Conversation log: reports, paging, nesting, feedback updates, history windows, export.

Tables: prompts(prompt_id, prompt_text, answer_text, conversation_id, user_feedback, created_at)
and conversations(conversation_id, length, user_feedback, user_feedback_message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import strip_markdown
from shelfspark.operators.skew import carry_forward, nest_in_parts, numbered, top_per_key

PAGE_SIZE = 50
DEEP_OFFSET = 10_000
RANGE_BINS = 1024
MAX_PROMPTS_PER_CONVERSATION = 10
MAX_HISTORY_MESSAGES = 50
RECENT_TURNS = 5
VALID_ROLES = ("system", "user", "assistant", "tool")


def date_range(df: DataFrame, ts: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows from the start of ``date_from`` to the end of ``date_to``; either side may be open.

    Plain comparisons on the stored column, so the bounds reach the file scan.
    """
    if date_from:
        df = df.filter(F.col(ts) >= F.lit(date_from).cast("date").cast("timestamp"))
    if date_to:
        df = df.filter(F.col(ts) < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp"))
    return df


def feedback_report(prompts: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    fb = F.col("user_feedback")
    return date_range(prompts, "created_at", date_from, date_to).agg(
        F.count_if(fb).alias("positive"),
        F.count_if(~fb).alias("negative"),
        F.count_if(fb.isNull()).alias("no_feedback"),
        F.count(F.lit(1)).alias("total"),
    )


def _with_parent(prompts: DataFrame, conversations: DataFrame) -> DataFrame:
    parent = conversations.select(
        "conversation_id",
        F.col("user_feedback").alias("conversation_feedback"),
        F.col("user_feedback_message").alias("conversation_message"),
    )
    return prompts.join(parent, "conversation_id", "left")


def page_prompts(
    prompts: DataFrame,
    conversations: DataFrame,
    offset: int = 0,
    limit: int = PAGE_SIZE,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """One page, newest first, with its conversation and the filtered total.

    The page is cut before the join, so only ``limit`` rows look up their parent. Beyond ``DEEP_OFFSET`` the id at
    the page's edge is found from counts of id ranges first, so no task holds the rows that are skipped.
    """
    kept = date_range(prompts, "created_at", date_from, date_to)
    total = kept.agg(F.count(F.lit(1))).scalar()
    if offset > DEEP_OFFSET:
        edge = id_at_rank(kept, "prompt_id", offset)
        if edge is None:
            return _with_parent(kept.limit(0), conversations).withColumn("total", total)
        first, above = edge
        page = kept.filter(F.col("prompt_id") <= first).orderBy(F.desc("prompt_id")).offset(offset - above).limit(limit)
    else:
        page = kept.orderBy(F.desc("prompt_id")).offset(offset).limit(limit)
    return _with_parent(page, conversations).withColumn("total", total)


def page_before(
    prompts: DataFrame,
    conversations: DataFrame,
    before: int | None = None,
    limit: int = PAGE_SIZE,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """The ``limit`` newest prompts with an id below ``before`` (all, if none), with conversation and filtered total.

    The last id of a page is the ``before`` of the next one; the bound reaches the scan, so every page costs the same.
    """
    kept = date_range(prompts, "created_at", date_from, date_to)
    total = kept.agg(F.count(F.lit(1))).scalar()
    older = kept if before is None else kept.filter(F.col("prompt_id") < before)
    page = older.orderBy(F.desc("prompt_id")).limit(limit)
    return _with_parent(page, conversations).withColumn("total", total)


def id_at_rank(df: DataFrame, name: str, rank: int, bins: int = RANGE_BINS) -> tuple[int, int] | None:
    """The id at 0-based ``rank`` in descending order and how many ids are above it; None behind the end.

    Each pass counts ids by range, at most ``bins`` of them, and goes on in the range that holds the rank.
    Null ids come after all others and have no rank.
    """
    ends = df.agg(F.min(name).alias("low"), F.max(name).alias("high"), F.count(name).alias("n")).first()
    if rank >= ends["n"]:
        return None
    low, high, above = ends["low"], ends["high"], 0
    while low < high:
        width = -(-(high - low + 1) // bins)
        inside = df.filter(F.col(name).between(low, high)).select(F.floor((F.lit(high) - F.col(name)) / width).cast("int").alias("bin"))
        for bin_, n in sorted(map(tuple, inside.groupBy("bin").count().collect())):
            if above + n > rank:
                high, low = high - bin_ * width, max(low, high - (bin_ + 1) * width + 1)
                break
            above += n
    return low, above


def prompts_with_conversation(prompts: DataFrame, conversations: DataFrame) -> DataFrame:
    return _with_parent(prompts, conversations).orderBy(F.desc("prompt_id"))


def nest_conversations(
    conversations: DataFrame,
    prompts: DataFrame,
    conversation_id: int | None = None,
    part_size: int = 1000,
) -> DataFrame:
    """Conversations with their prompts as an ordered array; empty ones keep an empty array.

    A conversation longer than ``part_size`` continues in rows with ``part`` 1, 2, ...
    """
    if conversation_id is not None:
        conversations = conversations.filter(F.col("conversation_id") == conversation_id)
        prompts = prompts.filter(F.col("conversation_id") == conversation_id)
    item = F.struct("prompt_id", "prompt_text", "answer_text", "user_feedback", "created_at")
    nested = nest_in_parts(
        prompts, ["conversation_id"], ["prompt_id"], item, "prompts", part_size
    )
    joined = conversations.join(nested, "conversation_id", "left")
    empty = F.array().cast(nested.schema["prompts"].dataType)
    return joined.withColumn("part", F.coalesce("part", F.lit(0).cast("bigint"))).withColumn(
        "prompts", F.coalesce("prompts", empty)
    )


def _nth_targets(prompts: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    last = updates.groupBy("conversation_id", "nth").agg(
        F.max_by("user_feedback", "ord").alias("new_feedback"), F.max("ord").alias("ord")
    )
    touched = prompts.select("conversation_id", "prompt_id").join(
        updates.select("conversation_id").distinct(), "conversation_id", "left_semi"
    )
    positions = numbered(touched, ["conversation_id"], ["prompt_id"], "_pos").select(
        "conversation_id", "prompt_id", (F.col("_pos") - 1).alias("nth")
    )
    return last, positions


def set_nth_feedback(prompts: DataFrame, updates: DataFrame) -> DataFrame:
    """Set feedback on the n-th (0-based, by id) prompt of a conversation; the last update wins.

    ``updates``: conversation_id, nth, user_feedback, ord.
    """
    last, positions = _nth_targets(prompts, updates)
    hits = positions.join(last, ["conversation_id", "nth"]).select(
        "prompt_id", F.lit(True).alias("_hit"), "new_feedback"
    )
    return (
        prompts.join(hits, "prompt_id", "left")
        .withColumn("user_feedback", F.when(F.col("_hit"), F.col("new_feedback")).otherwise(F.col("user_feedback")))
        .drop("_hit", "new_feedback")
    )


def rejected_nth_feedback(prompts: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates of :func:`set_nth_feedback` that point at no prompt."""
    _, positions = _nth_targets(prompts, updates)
    return updates.join(positions, ["conversation_id", "nth"], "left_anti")


def set_conversation_feedback(conversations: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite flag and message by conversation id; the last update wins.

    ``updates``: conversation_id, user_feedback, user_feedback_message, ord.
    """
    last = updates.groupBy("conversation_id").agg(
        F.max_by(F.struct("user_feedback", "user_feedback_message"), "ord").alias("_new")
    )
    joined = conversations.join(last, "conversation_id", "left")
    for name in ("user_feedback", "user_feedback_message"):
        joined = joined.withColumn(
            name, F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name))
        )
    return joined.drop("_new")


def append_prompts(prompts: DataFrame, batch: DataFrame, cap: int = MAX_PROMPTS_PER_CONVERSATION) -> DataFrame:
    """Decide and number a batch of new prompts (ord, conversation_id, prompt_text, answer_text).

    A row without a conversation opens a new one. A conversation takes at most ``cap``
    prompts in all; rows beyond it come back with status 'rejected' and no prompt id.
    """
    filled = prompts.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_filled"))
    old_ids = prompts.agg(
        F.coalesce(F.max("prompt_id"), F.lit(0)).alias("p"), F.coalesce(F.max("conversation_id"), F.lit(0)).alias("c")
    )
    batch_top = batch.agg(F.coalesce(F.max("conversation_id"), F.lit(0))).scalar()
    top_prompt = old_ids.select("p").scalar()
    top_conversation = F.greatest(old_ids.select("c").scalar(), batch_top)

    fresh = numbered(batch.filter(F.col("conversation_id").isNull()), [], ["ord"], "_n")
    fresh = fresh.select("ord", (top_conversation + F.col("_n")).alias("conversation_id"), "prompt_text", "answer_text")
    known = batch.filter(F.col("conversation_id").isNotNull())
    first = top_per_key(known, ["conversation_id"], ["ord"], cap, "_rank").join(filled, "conversation_id", "left")
    fitting = first.filter(F.coalesce("_filled", F.lit(0)) + F.col("_rank") <= cap)
    accepted = fitting.select("ord", "conversation_id", "prompt_text", "answer_text").unionByName(fresh)
    accepted = numbered(accepted, [], ["ord"], "_n").select(
        "ord",
        (top_prompt + F.col("_n")).alias("prompt_id"),
        F.col("conversation_id").alias("_conversation"),
    )
    return batch.join(accepted, "ord", "left").select(
        "ord",
        "prompt_id",
        F.coalesce("_conversation", "conversation_id").alias("conversation_id"),
        "prompt_text",
        "answer_text",
        F.when(F.col("prompt_id").isNull(), "rejected").otherwise("accepted").alias("status"),
    )


def delete_prompts(prompts: DataFrame, ids: DataFrame) -> DataFrame:
    return prompts.join(ids.select("prompt_id"), "prompt_id", "left_anti")


def delete_conversations(
    conversations: DataFrame, prompts: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remaining conversations and prompts; a conversation takes its prompts with it."""
    gone = ids.select("conversation_id")
    return (
        conversations.join(gone, "conversation_id", "left_anti"),
        prompts.join(gone, "conversation_id", "left_anti"),
    )


def recent_turns(prompts: DataFrame, n: int = RECENT_TURNS) -> DataFrame:
    """Last ``n`` prompts per conversation, then those with a question and an answer, oldest first."""
    last = top_per_key(prompts, ["conversation_id"], [F.desc("prompt_id")], n)
    full = last.filter((F.col("prompt_text") != "") & (F.col("answer_text") != ""))
    turn = F.struct("prompt_id", F.col("prompt_text").alias("question"), F.col("answer_text").alias("answer"))
    return full.groupBy("conversation_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def trim_messages(
    messages: DataFrame, max_messages: int = MAX_HISTORY_MESSAGES, last_n: int | None = None
) -> DataFrame:
    """The system rows and the last ``max_messages`` (or ``last_n``) other rows per conversation.

    ``messages``: conversation_id, turn, role, content. A null role is no system role, a null conversation is one.
    """
    system = messages.filter(F.col("role") == "system")
    rest = messages.filter(~F.col("role").eqNullSafe("system"))
    limit = max_messages if last_n is None else min(last_n, max_messages)
    return system.unionByName(top_per_key(rest, ["conversation_id"], [F.desc("turn")], limit))


def transcript(prompts: DataFrame, system_prompt: str) -> DataFrame:
    """Alternating user/assistant rows after one system row; order by (prompt_id, part)."""
    rows = F.array(
        F.struct(
            F.lit(1).alias("part"),
            F.lit("user").alias("role"),
            F.concat(F.lit("<user_message>\n"), F.col("prompt_text"), F.lit("\n</user_message>")).alias("content"),
        ),
        F.struct(F.lit(2).alias("part"), F.lit("assistant").alias("role"), F.col("answer_text").alias("content")),
    )
    turns = prompts.select("conversation_id", "prompt_id", F.inline(rows))
    heads = prompts.select("conversation_id").distinct().select(
        "conversation_id",
        F.lit(None).cast("bigint").alias("prompt_id"),
        F.lit(0).alias("part"),
        F.lit("system").alias("role"),
        F.lit(system_prompt).alias("content"),
    )
    return heads.unionByName(turns)


def validate_messages(messages: DataFrame) -> DataFrame:
    """Flag rows a model API would refuse; legacy 'function' rows are dropped first.

    ``messages``: conversation_id, turn, role, has_tool_calls. A null role is an unknown one, no call flag means no
    call, and a null conversation is a conversation.
    """
    kept = messages.filter(~F.col("role").eqNullSafe("function"))
    speaker = F.when(~F.col("role").eqNullSafe("tool"), F.struct("role", "has_tool_calls"))
    seen = carry_forward(kept, ["conversation_id"], ["turn"], speaker, "_speaker")
    tool = F.col("role") == "tool"
    problem = (
        F.when(F.col("role").isNull() | ~F.col("role").isin(*VALID_ROLES), "unknown_role")
        .when(tool & F.col("_speaker").isNull(), "tool_first")
        .when(tool & ~F.col("_speaker.role").eqNullSafe("assistant"), "tool_after_other_role")
        .when(tool & ~F.coalesce("_speaker.has_tool_calls", F.lit(False)), "tool_without_call")
    )
    return seen.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull()).drop("_speaker")


def conversation_ids(prompts: DataFrame) -> DataFrame:
    return prompts.select("conversation_id").distinct().orderBy(F.desc("conversation_id"))


def by_conversation(prompts: DataFrame, conversation_id: int) -> DataFrame:
    return prompts.filter(F.col("conversation_id") == conversation_id)


def export_rows(prompts: DataFrame, conversations: DataFrame) -> DataFrame:
    """The seven export columns as text: markdown removed, line breaks flattened."""

    def flat(c: str) -> Column:
        one_line = F.regexp_replace(strip_markdown(F.coalesce(F.col(c), F.lit(""))), r"\r?\n", " ")
        return F.regexp_replace(one_line, r"\s{2,}", " ")

    def label(c: str, yes: str, no: str) -> Column:
        return F.when(F.col(c), yes).when(~F.col(c), no).otherwise("")

    return _with_parent(prompts, conversations).select(
        F.col("prompt_id").cast("string").alias("promptId"),
        F.col("conversation_id").cast("string").alias("conversationId"),
        flat("prompt_text").alias("promptText"),
        flat("answer_text").alias("answerText"),
        label("user_feedback", "true", "false").alias("userFeedback"),
        label("conversation_feedback", "positive", "negative").alias("convoFeedback"),
        flat("conversation_message").alias("convoFeedbackMessage"),
    )


def export_prompts(prompts: DataFrame, conversations: DataFrame, path: str) -> None:
    """Write :func:`export_rows` newest first as CSV parts; the first header name carries the byte-order mark."""
    rows = export_rows(prompts, conversations).orderBy(F.col("promptId").cast("bigint").desc())
    rows.withColumnRenamed("promptId", "\ufeffpromptId").write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue=""
    )
