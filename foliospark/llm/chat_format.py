"""Chat formatting by multi-party perspective rotation.

For every speaker of a conversation the whole dialogue is rendered once with that speaker's turns as the
assistant's and everybody else as a named user. The mask lists the character spans [start, end) of the rendered
text that are trained on: what the assistant says, with the closing mark of the turn.

A turn is ``<|assistant|>\\n`` or ``<|user name=NAME|>\\n``, the text, and ``<|end|>\\n``. Turns are in the order of
(turn, role, text). So that nobody can write a mark, a backslash is put into every ``<|`` of a text or name (behind any backslashes that
stand between the two signs already, so it can be undone), and likewise into every ``|>`` of a name.

A dialogue is one row, part 0. Only where its turns have more than PART_BYTES (a string can't have over 2 GB, and a task has
to hold it) it is stored in parts, cut between turns by the bytes before them (numbers rise, and skip behind a turn of over PART_BYTES); the parts in order are the
whole, spans count from the start of their part, and a speaker gets all parts, also those without an own turn. The turns of
such a dialogue are numbered over range partitions, so no task gets all of them.

Defined cases: a null role is the speaker 'unknown'; a null text is empty; a null turn stands before turn 0;
a null conv_id is a conversation; repeated rows are turns of their own; a turn of over PART_BYTES is a part of its own; an empty
table gives no rows; roles in context_roles are shown as named users but get no rendering; a conversation of context_roles
alone gives no row; further columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import stored

PART_BYTES = 32 << 20
UNNAMED = "unknown"
#: The marks of the rendered text.
ASSISTANT = "<|assistant|>\n"
USER = ("<|user name=", "|>\n")
END = "<|end|>\n"
#: Bytes that a turn has beside its text and role, about.
MARK_BYTES = 32


def unmarked(text: Column) -> Column:
    """text in which no mark can begin."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unmarked_name(name: Column) -> Column:
    return F.regexp_replace(unmarked(name), r"\|(\\*)>", r"|$1\\>")


def _parted(rows: DataFrame, part_bytes: int) -> DataFrame:
    """rows with their part. rows: conv_id, turn, role, text, bytes."""
    order = ["conv_id", "turn", "role", "text"]
    sizes = rows.groupBy("conv_id").agg(F.sum("bytes").alias("n")).where(F.col("n") > part_bytes)
    long = stored(sizes.select(F.col("conv_id").alias("_long")), "long")
    if long.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    on = rows["conv_id"].eqNullSafe(long["_long"])
    short = rows.join(long, on, "left_anti").withColumn("part", F.lit(0).cast("long"))
    # running sums: within range partitions, and over the sums of the partitions before
    ranged = rows.join(long, on, "left_semi").repartitionByRange(*order).withColumn("bin", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    per = ranged.groupBy("conv_id", "bin").agg(F.sum("bytes").alias("n"))  # a row per partition and dialogue
    per = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.select(F.col("conv_id").alias("_long"), F.col("bin").alias("_bin"), "before")
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("conv_id", "bin").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = ranged.withColumn("inside", inside)
    summed = summed.join(F.broadcast(per), summed["conv_id"].eqNullSafe(per["_long"]) & (summed["bin"] == per["_bin"]))
    part = F.floor((F.col("before") + F.col("inside")) / part_bytes).cast("long")
    return short.unionByName(summed.withColumn("part", part).select(*short.columns))


def perspectives(turns: DataFrame, context_roles: tuple[str, ...] = (), part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per conversation and speaker (and part): conv_id, perspective, part, n_turns, text, mask (array of start, end)."""
    role, text = F.coalesce("role", F.lit(UNNAMED)), F.coalesce("text", F.lit(""))
    bytes_ = (F.octet_length(text) + F.octet_length(role) + MARK_BYTES).cast("long")
    rows = turns.select("conv_id", F.coalesce(F.col("turn"), F.lit(-1)).alias("turn"), role.alias("role"), text.alias("text"), bytes_.alias("bytes"))
    parts = _parted(rows, part_bytes).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = rows.select(F.col("conv_id").alias("_fs_conv"), F.col("role").alias("perspective")).distinct()
    if context_roles:
        speakers = speakers.where(~F.col("perspective").isin(*context_roles))
    both = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["_fs_conv"]))

    def mine(t: Column) -> Column:
        return t["role"] == F.col("perspective")

    def head(t: Column) -> Column:
        return F.when(mine(t), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER[0]), t["name"], F.lit(USER[1])))

    shown = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), unmarked_name(t["role"]).alias("name"), unmarked(t["text"]).alias("text")))
    both = both.withColumn("turns", shown)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "")
    sizes = F.transform("turns", lambda t: F.struct(F.length(head(t)).alias("head"), (F.length(t["text"]) + len(END)).alias("body"), mine(t).alias("own")))
    return both.select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), whole.alias("text"), _spans(sizes).alias("mask")
    )


def _spans(sizes: Column) -> Column:
    """(start, end) of the own turns, of sizes (head, body, own) one after another."""
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def walk(acc: Column, t: Column) -> Column:
        begin = acc["at"] + t["head"]
        end = begin + t["body"]
        own = F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(t["own"], own).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, start, walk)["spans"]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("conv_id", "perspective", "part", "n_turns", "text", spans.alias("mask"), masked.alias("n_masked"))


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
sp AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
seg AS (
  SELECT r.conv_id, perspective, turn, role, text, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') || '|>' || chr(10) END AS head
  FROM t r JOIN sp ON r.conv_id IS NOT DISTINCT FROM sp.conv_id),
pos AS (
  SELECT *, head || shown || '<|end|>' || chr(10) AS full_turn,
         sum(length(head) + length(shown) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM seg)
SELECT conv_id, perspective, CAST(0 AS BIGINT) AS part, count(*) AS n_turns,
       string_agg(full_turn, '' ORDER BY turn, role, text) AS text,
       coalesce(string_agg((stop - length(shown) - 8) || '-' || stop, ',' ORDER BY stop) FILTER (WHERE own), '') AS mask,
       CAST(coalesce(sum(length(shown) + 8) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM pos GROUP BY conv_id, perspective
"""
