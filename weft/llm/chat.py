"""Chat formatting of reply trees, with DataFrame functions only.

Messages reply to messages, so a tree has one path for each leaf. Iterative
self-joins double the length of each message's known way up in every round, so
log2(depth) rounds give the score of every root-to-leaf path; the best branch is
chosen, and as many joins back enumerate its messages. The joins carry ids and
scores, never texts, and a round works only on messages whose way up isn't known yet.

A conversation's chosen path is put together in one row, as its format asks: the texts of one path
have to fit into a task, those of a tree need not.

The template is ``<s>`` and for each turn ``[INST]role[/INST]text</s>``. Inside roles
and texts a control string gets one more tilde after its first letter, which
also holds for one that has tildes already, so taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import stored, table

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)(/?s>|/?INST\])", "$1~$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)(/?s>|/?INST\])", "$1$2$3")


def best_paths(messages: DataFrame) -> DataFrame:
    """The messages on each tree's best path, with their depth (1 for the root).

    messages: tree, node, parent (null for a root), score. The best leaf has the
    highest sum of scores (null: 0) on its path, then the deepest place, then the
    smallest node. Returns tree, node, depth. Messages below a parent that isn't there
    or in a circle are on no path; null trees are left out.
    """
    base = messages.filter(F.col("tree").isNotNull() & F.col("node").isNotNull())
    most = base.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    rounds = int(most).bit_length()
    step = stored(base.select("tree", "node", F.col("parent").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth"), (F.col("parent").isNotNull()).alias("open")), "reply-step")
    done, still, ways = step.filter("up IS NULL"), step.filter("up IS NOT NULL"), []
    for _ in range(rounds):  # a circle ends here, all else when no way leads further
        if still.isEmpty():
            break
        ways.append(still.select("tree", "node", "up"))
        known = done.unionByName(still)
        above = known.select(F.col("tree"), F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("depth").alias("_depth"), F.col("open").alias("_open"))
        moved = stored(
            still.join(above, ["tree", "up"], "left").select(
                "tree",
                "node",
                F.col("_up").alias("up"),
                (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                F.coalesce("_open", "open").alias("open"),  # a parent that isn't there stays open
            ),
            "reply-step",
        )
        done, still = done.unionByName(moved.filter("up IS NULL")), moved.filter("up IS NOT NULL")
    replied = step.filter("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = done.filter(~F.col("open")).join(replied, ["tree", "node"], "left_anti")
    path = leaves.groupBy("tree").agg(F.min_by("node", F.struct(-F.col("total"), -F.col("depth"), F.col("node"))).alias("node"))
    for way in reversed(ways):
        path = path.join(way, ["tree", "node"], "left")
        path = path.select("tree", F.explode(F.array("node", "up")).alias("node")).filter("node is not null")
    return path.join(done.select("tree", "node", "depth"), ["tree", "node"])


def format_conversations(messages: DataFrame) -> DataFrame:
    """tree, formatted, mask (array of start and end in code points) for each tree's best path.

    messages: tree, node, parent, score, role, text; other columns aren't read. Null
    roles and texts are empty. The mask covers the texts of the trained role, as they stand in
    the output.
    """
    path = best_paths(messages.select("tree", "node", "parent", "score"))
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(said, ["tree", "node"]).select("tree", "depth", "role", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE)).alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("n_head", F.length("head")).withColumn("n", F.col("n_head") + F.length("body") + len(END))
    before = F.sum("n").over(W.partitionBy("tree").orderBy("depth").rowsBetween(W.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)) + len(BEGIN) + F.col("n_head"))
    part = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("said"), (F.col("role") == TRAINED_ROLE).alias("trained"), "start", (F.col("start") + F.length("body")).alias("end"))
    grouped = turns.groupBy("tree").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select(
        "tree",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("parts", lambda p: p["said"]), "")).alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["trained"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, turns (array of role and text) and trained (the masked texts in order), from the output alone."""
    said = F.split(F.substring("formatted", len(BEGIN) + 1, 2**31 - 1), END)
    turns = F.transform(
        F.slice(said, 1, F.size(said) - 1),
        lambda t: F.struct(
            unescaped(F.substring_index(F.substring(t, len(OPEN) + 1, 2**31 - 1), CLOSE, 1)).alias("role"),
            unescaped(F.substring(t, F.instr(t, CLOSE) + len(CLOSE), 2**31 - 1)).alias("text"),
        ),
    )
    trained = F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"])))
    return formatted.select("tree", turns.alias("turns"), trained.alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"))


def as_messages(conversations: DataFrame) -> DataFrame:
    """Rows of conversations as reply chains: each row replies to the one before it.

    Rows go by turn (null first), then by role and text, so repeated rows follow each
    other in a defined order; rows without conv_id are left out.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output.

    An empty table gives no rows.
    """
    messages = stored(as_messages(conversations), "reply-messages")
    back = read_back(format_conversations(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT cast(-7 AS bigint) AS conv_id, cast(n AS bigint) AS turn, r AS role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(n, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(rows.unionByName(extra))


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, length(regexp_replace(role, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g')) + 17 AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + 3)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
