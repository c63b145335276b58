"""Chat formatting of reply trees, in DataFrame functions only.

Every message names its parent. Iterative self-joins double the distance that each message sees
up its branch, which gives depth and score of every root-to-leaf path after logarithmically many
rounds; branches are ranked by score (the sum of their messages' scores; ties to the smaller
leaf), and the messages on a chosen branch are found by joining back through the doubled
distances. Each chosen path is formatted as one conversation.

Template: `<s>ROLE[INST]TEXT</s>` for each message. Inside roles and texts every control string
(`<s>`, `</s>`, `[INST]`, `[/INST]`) gets a backslash after its first character, in front of any
backslashes already there, so removing one backslash restores it. The loss mask holds spans
(start, length in code points of the formatted text) of the assistant's texts.

Defined results: null text and null role are empty; messages with a null tree or node, or on a
cycle of parents, take no part; a parent that doesn't exist makes a root. In a linear
conversation rows are ordered by turn (null first), then role and text; rows with a null
conversation take no part; equal rows are turns of their own. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm.common import table, written

LEARNT = "assistant"
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<(\\*)(/?s>)", r"<\\$1$2"), r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<\\(\\*)(/?s>)", r"<$1$2"), r"\[\\(\\*)(/?INST\])", r"[$1$2")


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, seat, node): the messages of the best `branches` root-to-leaf paths of each tree (None: all), seat 0 at the leaf.

    messages: tree, node, parent, score (null: 0); tree and node are a key.
    """
    nodes = messages.filter("tree is not null and node is not null").select("tree", "node", "parent", F.coalesce("score", F.lit(0)).cast("double").alias("total"))
    real = nodes.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    start = nodes.join(real, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("up")), "left").select("tree", "node", "up", "total")
    level = written(start)
    count, levels, done = level.count(), [], level.filter("up is null")
    level = level.filter("up is not null")
    # Messages that see their root are done; only the others are joined again, on all of their tree.
    while level.take(1) and 2 ** len(levels) <= count:
        levels.append(level.select("tree", "node", "up"))
        above = done.union(level).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("total").alias("more"))
        made = written(level.join(above, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total")))
        done, level = done.union(made.filter("up is null")), made.filter("up is not null")
    inner = start.filter("up is not null").select("tree", F.col("up").alias("node"))
    leaves = done.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "total")
    if branches is not None:
        place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
        leaves = leaves.withColumn("place", place).filter(F.col("place") <= branches)
    found = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("seat"))
    for k in reversed(range(len(levels))):
        up = levels[k]
        both = F.explode(F.array(F.struct(F.col("node"), F.col("seat")), F.struct(F.col("up").alias("node"), (F.col("seat") + 2**k).alias("seat"))))
        found = found.join(up, ["tree", "node"], "left").select("tree", "leaf", both.alias("x")).filter("x.node is not null").select("tree", "leaf", "x.node", "x.seat")
    return found


def conversations(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, formatted, loss_spans array<struct<start,length>> of each chosen path.

    messages: tree, node, parent, role, text, score; a path is one row, whose size is that of the conversation.
    """
    texts = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths(messages, branches).join(texts, ["tree", "node"])
    turn = F.struct((-F.col("seat")).alias("seat"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    held = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    held = held.withColumn("formatted", F.expr("array_join(transform(turns, t -> concat('<s>', t.role, '[INST]', t.text, '</s>')), '')"))
    # Running end of each turn; an assistant's text ends four characters before it.
    ends = "aggregate(turns, cast(array() as array<bigint>), (a, t) -> array_append(a, coalesce(try_element_at(a, -1), 0L) + 13L + length(t.role) + length(t.text)))"
    spans = f"transform(filter(arrays_zip(turns, e), x -> x.turns.role = '{LEARNT}'), x -> struct(x.e - 3L - length(x.turns.text) as start, cast(length(x.turns.text) as bigint) as length))"
    return held.withColumn("e", F.expr(ends)).withColumn("loss_spans", F.expr(spans)).select("tree", "leaf", "formatted", "loss_spans")


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    parts = F.split(formatted, "</s>", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p):
        at = F.instr(p, F.lit("[INST]"))
        return F.struct(unescape(p.substr(F.lit(4), at - 4)).alias("role"), unescape(p.substr(at + 6, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def linear_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A linear conversation as a tree of one branch: each row answers the row before."""
    base = rows.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    base = base.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return base.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    made = conversations(written(linear_messages(rows.union(probe))))
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int"), s["length"].cast("int")))), "")
    return made.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations WHERE conv_id IS NOT NULL
UNION ALL SELECT -7, 0, 'user', '{PROBE}', 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}', 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNT}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = '{LEARNT}' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
  CAST(sum(13 + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

QUERIES = {"op8_chat_format": op8_chat_format}
ORACLES = {"op8_chat_format": SQL}
