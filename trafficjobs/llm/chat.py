"""Chat formatting from event logs, in DataFrame functions only.

An event log has conv_id, turn, seq, op, role and text. A log is partitioned by conversation and sorted by seq; the events of
a turn then fold into messages: `message` opens one, `delta` adds to it, `edit` replaces its text, `regenerate` empties it for
the deltas that follow and takes back all that later turns had said until then. A delta, edit or regeneration without a
message opens one. Messages are rendered as

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>\\n

Inside roles and texts every backslash is doubled and each control string gets a backslash after its first character, so
that no control string is left and `unescape` restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings of common templates as a pattern; the groups are the first character and the rest.
CONTROL = r"(<)(\||/?s>|/?<SYS>>|</?SYS>>)|(\[)(/?INST\])"
_FOLDED = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, text: the final messages; part numbers the messages of one turn.

    Events are sorted by seq, then op, role and text, so that ties give one result; null seq comes first, null roles and
    texts are empty, an unknown or null op counts as message. Turns without a number come before the others. A turn of
    which nothing is left gives no row, nor does an empty log; repeated events count as often as they occur.
    """
    op = F.when(F.col("op").isin("delta", "edit", "regenerate"), F.col("op")).otherwise(F.lit("message"))
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63)).cast("long"))
    event = F.struct(seq.alias("seq"), op.alias("op"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("log"), F.max(F.when(op == "regenerate", seq)).alias("redone"))
    # what stands at or before the last regeneration of an earlier turn is taken back
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    logs = logs.withColumn("since", F.max("redone").over(earlier))
    logs = logs.withColumn("log", F.when(F.col("since").isNull(), F.col("log")).otherwise(F.filter("log", lambda e: e["seq"] > F.col("since"))))

    def step(done: Column, e: Column) -> Column:
        last = F.element_at(done, -1)
        role = F.when(e["role"] != "", e["role"]).otherwise(last["role"])
        text = F.when(e["op"] == "delta", F.concat(last["text"], e["text"])).when(e["op"] == "edit", e["text"]).otherwise(F.lit(""))
        fresh = F.array(F.struct(e["role"].alias("role"), F.when(e["op"] == "regenerate", F.lit("")).otherwise(e["text"]).alias("text")))
        opens = (e["op"] == "message") | (F.size(done) == 0)
        return F.when(opens, F.concat(done, fresh)).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(role.alias("role"), text.alias("text")))))

    folded = F.aggregate("log", F.array().cast(_FOLDED), step)
    return logs.select("conv_id", "turn", F.posexplode(folded).alias("part", "m")).select("conv_id", "turn", "part", "m.role", "m.text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: the text of each conversation, and where assistant texts stand in it (start, end in code points).

    Positions and the text share the partitioning by conversation. Messages with a null role or text must be folded first;
    a conversation without messages has no row.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit(SEP))
    rows = messages.select("conv_id", "turn", "part", "role", head.alias("head"), text.alias("body"))
    rows = rows.select("conv_id", "turn", "part", "role", F.concat("head", "body", F.lit(END)).alias("piece"), F.char_length("head").alias("before"), F.char_length("body").alias("inside"))
    order = Window.partitionBy("conv_id").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.char_length("piece")).over(order))
    start = F.col("end") - F.char_length("piece") + F.col("before")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.col("inside")).alias("end")))
    parts = rows.select("conv_id", F.struct(F.col("end").alias("at"), F.col("turn"), F.col("part"), F.col("piece"), span.alias("span")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    spans = F.transform(F.filter("ps", lambda p: p["span"].isNotNull()), lambda p: p["span"])
    return whole.select("conv_id", F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns, array of (role, text) parsed from the text, and loss_texts, what the spans hold, both unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    body = lambda p: F.substring_index(F.substring_index(p, SEP, -1), END, 1)
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(body(p)).alias("text")))
    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_texts": under})


def as_log(conversations: DataFrame) -> DataFrame:
    """A streamed log that folds to the table conv_id, turn, role, text: conv_id, turn, seq, op, role, text.

    A row's hash chooses its history. Every row comes as a message that deltas at two places of the text complete. Some rows
    had a draft before, which an edit or a regeneration replaced; where it was a regeneration the next turn had begun
    already, and is taken back. Rows of one turn are ordered by role and text, equal rows stay as many.
    """
    said = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") * 10
    mark = F.xxhash64("conv_id", "turn", "role", "text")
    rows = said.select("*", at.alias("at"), F.pmod(mark, F.lit(4)).alias("kind"), F.char_length("text").alias("n"), F.pmod(F.shiftright(mark, 8), F.lit(1000)).alias("x"), F.pmod(F.shiftright(mark, 24), F.lit(1000)).alias("y"))
    rows = rows.withColumns({"p": (F.least("x", "y") * F.col("n") / 1000).cast("int"), "q": (F.greatest("x", "y") * F.col("n") / 1000).cast("int")})
    head, middle, tail = (F.substring("text", F.lit(1), F.col("p")), F.substring("text", F.col("p") + 1, F.col("q") - F.col("p")), F.substring("text", F.col("q") + 1, F.col("n") - F.col("q")))
    event = lambda k, op, text, turn=F.col("turn"), role=F.col("role"): F.struct(turn.alias("turn"), (F.col("at") + k).alias("seq"), F.lit(op).alias("op"), role.alias("role"), text.alias("text"))
    draft, none = F.concat(F.lit("draft "), tail), F.lit("")
    plain = F.array(event(4, "message", head), event(5, "delta", middle, role=none), event(6, "delta", tail, role=none))
    edited = F.array(event(0, "message", draft), event(4, "edit", head, role=none), event(5, "delta", middle, role=none), event(6, "delta", tail, role=none))
    follow = F.when(F.col("turn").isNotNull(), F.array(event(1, "message", draft, F.try_add(F.col("turn"), F.lit(1).cast(conversations.schema["turn"].dataType)))))
    again = F.array(event(0, "message", draft), event(2, "regenerate", none, role=none), event(5, "delta", F.concat(head, middle), role=none), event(6, "delta", tail, role=none))
    again = F.concat(again, F.coalesce(F.filter(follow, lambda e: e["turn"].isNotNull()), F.array().cast(rows.select(plain).schema[0].dataType)))
    history = F.when(F.col("kind") == 0, edited).when(F.col("kind") == 1, again).otherwise(plain)
    return rows.select("conv_id", F.explode(history).alias("e")).select("conv_id", "e.turn", "e.seq", "e.op", "e.role", "e.text")


def summary(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from what the table's log renders to.

    Null roles and texts are empty, a null turn comes first, a null conv_id is a conversation of its own. An empty table gives
    an empty result; extra columns are ignored.
    """
    read = read_back(render(fold(as_log(conversations))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL of summary() over the table and conversation -7.
SUMMARY_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, '<|im_start|>' || regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>|/?<SYS>>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')
    || '<|im_sep|>' || regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|/?<SYS>>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') || '<|im_end|>' || chr(10) AS piece
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, sum(length(piece)) AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
