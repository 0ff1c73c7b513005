"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that start with `>` are quotes, as deep as they have marks. Runs of quoted lines of one depth
are passages; passages and their lines are normalised (lower case, single spaces) and hashed, and joined
by (conversation, hash) to the messages that wrote them first-hand. Each quote links to the latest
earlier message with that passage, found by one pass over each (conversation, hash) in turn order, so
a phrase that is said a thousand times makes no pairs. A message replies to the message it quotes most
of, else to the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screentone.llm.common import stored

#: Marks at the start of a line, as one run of a character class: no recursion on long runs.
MARKS = r"^([ \t]*>[> \t]*)"


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, c and t (keys without nulls), lines (depth, body)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marks = lambda s: F.regexp_extract(s, MARKS, 1)
    lines = F.transform(
        F.split(text, "\r?\n"),
        lambda s: F.struct(
            (F.length(marks(s)) - F.length(F.replace(marks(s), F.lit(">"), F.lit("")))).alias("depth"),
            F.when(marks(s) == "", s).otherwise(F.ltrim(F.regexp_replace(s, MARKS, ""))).alias("body"),
        ),
    )
    return messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("-")).alias("c"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("t"),
        lines.alias("lines"),
    )


def _runs(lines: str) -> Column:
    """array<struct<depth, bodies>>: maximal runs of lines of one depth; blank own lines end a run."""
    blank = lambda x: F.trim(x["body"]) == ""
    empty = F.array().cast("array<struct<depth:int,bodies:array<string>>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last["depth"]) == x["depth"]) & ~blank(x)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x["depth"].alias("depth"), F.concat(last["bodies"], F.array(x["body"])).alias("bodies"))))
        fresh = F.concat(acc, F.array(F.struct(x["depth"].alias("depth"), F.when(blank(x), F.array().cast("array<string>")).otherwise(F.array(x["body"])).alias("bodies"))))
        return F.when(same, grown).otherwise(fresh)

    return F.filter(F.aggregate(lines, empty, step), lambda r: F.size(r["bodies"]) > 0)


def _pieces(runs: Column) -> Column:
    """array<struct<depth, piece>>: each run as one passage, and its lines, normalised."""
    one = F.transform(runs, lambda r: F.struct(r["depth"].alias("depth"), _normal(F.array_join(r["bodies"], " ")).alias("piece")))
    each = F.flatten(F.transform(runs, lambda r: F.transform(r["bodies"], lambda b: F.struct(r["depth"].alias("depth"), _normal(b).alias("piece")))))
    return F.array_distinct(F.filter(F.concat(one, each), lambda p: p["piece"] != ""))


def quote_links(parsed: DataFrame) -> DataFrame:
    """(c, t, depth, source, n): how many characters message t quotes of the earlier message source."""
    quoting = parsed.filter(F.exists("lines", lambda x: x["depth"] > 0))
    key = F.md5("p.piece").alias("hash")
    quoted = quoting.select("c", "t", F.explode(_pieces(_runs("lines"))).alias("p")).filter("p.depth > 0").select("c", "t", "p.depth", key, F.length("p.piece").alias("n")).distinct()
    quoted = stored(quoted, "quotes")
    # only messages of conversations with quotes are hashed, and only passages that are quoted stay
    own = parsed.join(quoted.select("c").distinct(), "c", "left_semi").select("c", "t", F.filter("lines", lambda x: x["depth"] == 0).alias("lines"))
    said = own.select("c", "t", F.explode(_pieces(_runs("lines"))).alias("p")).select("c", "t", key).distinct()
    said = said.join(quoted.select("c", "hash").distinct(), ["c", "hash"], "left_semi")
    both = quoted.select("c", "hash", "t", "depth", "n", F.lit(None).cast("long").alias("source")).unionByName(
        said.select("c", "hash", "t", F.lit(0).alias("depth"), F.lit(0).alias("n"), F.col("t").alias("source"))
    )
    # what the same turn says comes after what it quotes, so that a message never links to itself
    order = Window.partitionBy("c", "hash").orderBy("t", F.col("source").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = both.withColumn("source", F.last("source", ignorenulls=True).over(order)).filter("depth > 0 AND source IS NOT NULL AND source < t")
    return linked.groupBy("c", "t", "depth", "source").agg(F.sum("n").alias("n"))


def _before(rows: DataFrame, at: str, cell: int, last: str | None = None) -> DataFrame:
    """rows plus `rank` (from 0, by `at`, then t) and, if asked for, `prev`, the `last` value of the row before.

    Two steps, inside cells of `cell` values of `at` and over the cells, so that a conversation with
    a third of all messages is no single task's work.
    """
    r = rows.withColumn("cell", F.floor(F.col(at) / cell))
    inner = Window.partitionBy("c", "cell").orderBy(at, "t")
    r = r.withColumn("rank", F.row_number().over(inner) - 1)
    cells = r.groupBy("c", "cell").agg(F.count("*").alias("m"), F.max(last or at).alias("top"))
    over = Window.partitionBy("c").orderBy("cell")
    cells = cells.select(
        F.col("c").alias("c2"),
        F.col("cell").alias("cell2"),
        F.coalesce(F.sum("m").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("m0"),
        F.lag("top").over(over).alias("top0"),
    )
    if last:
        r = r.withColumn("prev", F.lag(last).over(inner))
    r = r.join(cells, (F.col("c") == F.col("c2")) & (F.col("cell") == F.col("cell2")))
    r = r.withColumn("rank", F.col("rank") + F.col("m0"))
    if last:
        r = r.withColumn("prev", F.coalesce("prev", "top0"))
    return r.drop("c2", "cell2", "m0", "top0", "cell")


def conversations(messages: DataFrame, cell: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, n_quotes, position, text (without quotes), chat.

    reply_to: the turn it quotes most of at depth 1 (ties: the latest), else the turn before it in the
    conversation, null for the first. position counts from 0 in reply order: by the message replied
    to, then by turn, so every message follows the one it answers and replies to one message stand
    together. text drops quoted lines and the line before a quote that only names its author; chat
    is the message as one training line. Null texts are empty, a null turn comes first, messages
    without conversation form one. Repeated (conversation, turn) rows share reply_to and get
    neighbouring positions in any order. An empty table gives an empty result; other columns are ignored.
    """
    parsed = parse(messages, conv_col, turn_col, role_col, text_col)
    links = stored(quote_links(parsed), "quote-links")
    best = links.filter("depth = 1").groupBy("c", "t").agg(F.max(F.struct("n", "source")).alias("b"), F.sum("n").alias("n_quoted"))
    counts = links.groupBy("c", "t").agg(F.countDistinct("source", "depth").alias("n_quotes"))
    turns = _before(parsed.select("c", "t").distinct(), "t", cell, last="t").select("c", "t", "prev")
    replies = turns.join(best, ["c", "t"], "left").join(counts, ["c", "t"], "left")
    replies = replies.select("c", "t", F.coalesce("b.source", "prev").alias("reply"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"))
    n = F.size("lines")
    header = r"(?i)^\s*(on\b.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$"
    own = F.filter(
        F.transform("lines", lambda x, i: F.struct(x["depth"].alias("depth"), x["body"].alias("body"), (x["body"].rlike(header) & (F.coalesce(F.get("lines", i + 1)["depth"], F.lit(0)) > 0)).alias("head"))),
        lambda x: (x["depth"] == 0) & ~x["head"],
    )
    text = F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", ""))
    body = parsed.select("conv_id", "turn", "role", "c", "t", F.when(n > 0, text).otherwise("").alias("text"))
    placed = _before(body.join(replies, ["c", "t"]).withColumn("at", F.coalesce("reply", F.lit(-2))), "at", cell)
    chat = F.concat(F.lit("<|"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.lit("|>\n"), F.col("text"))
    kind = messages.schema[turn_col].dataType
    reply = F.when(F.col("reply") >= 0, F.col("reply")).cast(kind)
    return placed.select("conv_id", "turn", "role", reply.alias("reply_to"), "n_quotes", F.col("rank").cast("long").alias("position"), "text", chat.alias("chat"))
