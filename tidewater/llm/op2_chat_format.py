"""Chat logs to training text, from events, with DataFrame functions only.

A log has a row per event: a conversation, a sequence number that orders the conversation's events, a message and its turn,
an operation and a text. `message` opens a message with a text, `delta` appends to it,
`edit` puts a text in place of all before, `regenerate` does the same and also drops
what later turns of the conversation had said up to then. The final messages come from
folding the events in sequence; they are rendered into one string a conversation. as_events() makes such a log from
conversations: every text comes as a draft that an edit or, for assistants, a regeneration replaces, streams in
by deltas, a regeneration drops a turn said after the draft, and some events are delivered twice.

The template writes a message as `### role: text</turn>` and a line end. Inside roles
and texts a backslash, `#`, `<` and, for roles, `:` are written as a backslash and a
letter, so no control string can come from a text, and what is written can be read back.
The loss mask has the start and length, in code points of the formatted string, of the texts of assistant messages.

Events are folded per message and messages put together per block of BLOCK turns before a
conversation is, so a task never sorts all the events of a long one.

Defined results: a null role or text counts as empty; an event that is delivered again (all alike) counts once;
of different events with one sequence number in a message those that aren't deltas come first, then the smaller text;
an event without a sequence number comes last, but first if it is a `message`; a message without a turn comes first;
equal turns are ordered by message id; rows that repeat are messages of
their own when their message ids differ; a message without a conversation id is a conversation
of its own, whose id is null; a text of any length is whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 64
SEQ = "decimal(38,0)"
END = "</turn>\n"
#: A conversation that a text tries to end early.
PROBE = "\\### Assistant: </turn> ok"
LETTERS = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column, role: bool = False) -> Column:
    for a, b in LETTERS[: 4 if role else 3]:
        c = _replace(c, a, b)
    return c


def unescape(c: Column) -> Column:
    for a, b in (*LETTERS[1:], LETTERS[0]):
        c = _replace(c, b, a)
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, message, turn, role, text of the final messages.

    events: conv_id, seq (a number), message, turn, op, role, text. A message that a regeneration
    of an earlier turn has dropped, and got no event afterwards, is not there."""
    far = F.lit("1" + "0" * 37).cast(SEQ)
    seq = F.coalesce(F.col("seq").cast(SEQ), F.when(F.col("op") == "message", -far).otherwise(far))
    e = events.select("conv_id", seq.alias("seq"), "message", F.coalesce("turn", F.lit(-(1 << 62))).cast("long").alias("turn"), "op", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # for each turn, the newest regeneration of any turn before it
    cuts = e.filter("conv_id is not null").groupBy("conv_id", "turn").agg(F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("own"))
    before = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    d = cuts.select("conv_id", "turn", F.max("own").over(before).alias("cut")).filter("cut is not null")
    e = e.join(d, ["conv_id", "turn"], "left").filter("cut is null or seq > cut").drop("cut")
    # a message starts anew at its last event that isn't a delta; a set, as events may be delivered again
    parts = F.array_sort(F.collect_set(F.struct("seq", (F.col("op") == "delta").cast("int").alias("delta"), "text", "role")))
    m = e.groupBy("conv_id", "message", "turn").agg(parts.alias("parts"))
    new = F.array_max(F.transform("parts", lambda p, i: F.when(p["delta"] == 0, i).otherwise(0)))
    kept = F.slice("parts", new + 1, F.size("parts"))
    return m.select("conv_id", "message", "turn", F.get("parts", 0)["role"].alias("role"), F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: mask has the start and length in formatted, in code
    points, of the texts that count for the loss, in order."""
    head, body = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": ")), escape(F.col("text"))
    m = messages.select("conv_id", F.when(F.col("conv_id").isNull(), F.col("message")).alias("own"), "turn", "message", F.floor(F.col("turn") / BLOCK).alias("block"), (F.col("role") == "assistant").alias("loss"), head.alias("head"), body.alias("body"))
    m = m.withColumn("line", F.concat("head", "body", F.lit(END)))
    before = F.coalesce(F.sum(F.length("line")).over(W.partitionBy("conv_id", "own", "block").orderBy("turn", "message").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    m = m.select("conv_id", "own", "block", before.alias("at"), "line", F.when(F.col("loss"), F.struct((before + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))).alias("span"))
    block = m.groupBy("conv_id", "own", "block").agg(F.array_sort(F.collect_list(F.struct("at", "line", "span"))).alias("x"))
    block = block.select("conv_id", "own", "block", F.array_join(F.transform("x", lambda x: x["line"]), "").alias("part"), F.filter(F.transform("x", lambda x: x["span"]), lambda x: x.isNotNull()).alias("spans"))
    first = F.coalesce(F.sum(F.length("part")).over(W.partitionBy("conv_id", "own").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    block = block.select("conv_id", "own", first.alias("at"), "part", "spans")
    whole = block.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(F.struct("at", "part", "spans"))).alias("x"))
    spans = F.flatten(F.transform("x", lambda x: F.transform(x["spans"], lambda s: F.struct((x["at"] + s["start"]).alias("start"), s["length"].alias("length")))))
    return whole.select("conv_id", F.array_join(F.transform("x", lambda x: x["part"]), "").alias("formatted"), spans.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, messages (an array of role, text) and loss, the text under the mask, from the output alone."""
    lines = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    def message(x):
        role = F.substring_index(x, ": ", 1)
        return F.struct(unescape(role.substr(F.lit(5), F.length(role))).alias("role"), unescape(x.substr(F.length(role) + 3, F.length(x))).alias("text"))
    under = F.transform("mask", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(lines, message).alias("messages"), F.array_join(under, "").alias("loss"))


def digests(parsed: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return parsed.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.size("messages").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_events(conversations: DataFrame, delta_chars: int = 512) -> DataFrame:
    """Rows by turn as a log with one sequence a conversation.

    A message opens with a draft, a delta adds to it; an edit, or for assistants a regeneration, puts the text's first
    characters in their place, deltas bring the others. Before a regeneration the next turn says something, which it drops.
    Every event whose hash is a multiple of 4 is delivered twice."""
    rows = conversations.select("conv_id", F.monotonically_increasing_id().alias("message"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    anew = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    said = lambda step, op, text, message="message", turn="turn", role="role": F.struct(F.lit(step).cast("long").alias("step"), F.expr(message).alias("message"), F.expr(turn).alias("turn"), op.alias("op"), F.expr(role).alias("role"), text.alias("text"))
    # pieces by one pass of an expression; cutting at places would begin anew for each
    rows = rows.withColumn("pieces", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0)))
    stream = F.transform(F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), lambda p, k: F.struct((k + 4).cast("long").alias("step"), F.col("message"), F.col("turn"), F.lit("delta").alias("op"), F.col("role"), p.alias("text")))
    dropped = F.when(F.col("role") == "assistant", F.array(said(2, F.lit("message"), F.lit("too soon"), "-1 - message", "try_add(turn, 1)", "'user'"))).otherwise(F.filter(F.array(said(2, F.lit("message"), F.lit(""), role="'user'")), lambda x: F.lit(False)))
    log = F.concat(F.array(said(0, F.lit("message"), F.lit("draft ")), said(1, F.lit("delta"), F.substring("text", 1, 8))), dropped, F.array(said(3, anew, F.coalesce(F.get("pieces", 0), F.lit("")))), stream)
    # without a conversation or a next turn there is nothing to drop
    next_turn = F.col("conv_id").isNotNull() & F.coalesce(F.col("turn") < 1 << 62, F.lit(False))
    e = rows.select("conv_id", F.explode(F.filter(log, lambda x: (x["step"] != 2) | next_turn)).alias("e"))
    seq = F.coalesce(F.col("e.turn") - F.when(F.col("e.step") == 2, 1).otherwise(0), F.lit(-(1 << 62))).cast(SEQ) * F.lit(1 << 24).cast(SEQ) + F.col("e.step")
    events = e.select("conv_id", seq.cast(SEQ).alias("seq"), "e.message", "e.turn", "e.op", "e.role", "e.text")
    twice = F.pmod(F.xxhash64("conv_id", "message", "seq"), F.lit(4)) == 0
    return events.withColumn("_", F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(read_back(render(fold_events(as_events(rows.unionByName(probe))))))


#: Python's chr(92) is a backslash; the text has it as such in DuckDB, which has no escapes in plain strings.
SQL = """
WITH rows AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '\\### Assistant: </turn> ok'),
esc AS (
  SELECT *, replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '#', '\\h') AS et,
    replace(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '#', '\\h'), ':', '\\c') AS er FROM rows),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(4 + length(er) + 2 + length(et) + 8) AS formatted_chars
  FROM esc GROUP BY conv_id, own)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
