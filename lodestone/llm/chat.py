"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant; all others
are users, named by their role or speaker name. Only the assistant's words are trained on: each rendered turn carries
the spans of the rendered dialogue, in characters, whose loss counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total

TURNS_IN_A_BUCKET = 1000


def rotate(turns: DataFrame, open_tag: str = "<|im_start|>", close_tag: str = "<|im_end|>", never: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row for each turn and perspective of turns(conv_id, turn, role, text).

    conv_id, perspective, turn, role ('assistant', 'user' or the role itself if in `never`), name (null but for users),
    segment (the rendered turn), start and stop (of the segment in the dialogue, which is the concatenation of its
    segments in order of turn, role and text), mask_start and mask_stop (the trained part: text and close tag of the
    assistant's turns, else null), copies (how many equal turns stood here).

    Tags inside texts and names are escaped by a backslash behind their first character, and line breaks in names become
    spaces, so that no speaker can write a turn for another. Roles in `never`, such as system, are rendered as themselves and get no perspective. Null conv_id or turn: left
    out, as the row belongs to no place in a dialogue. Null role: the speaker 'unknown'. Null text: empty. Turns that
    are equal in all columns count once, with their number in `copies`; different turns with one number follow each
    other by role and text. A conversation of any length is spread over tasks by thousands of turns; nothing is
    gathered. The number of rows is the number of turns times the speakers of their conversation.
    Very long texts are read whole. An empty table gives an empty result; other columns are not read.
    """
    t = turns.where("conv_id is not null and turn is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")
    )
    for tag in (open_tag, close_tag):
        for c in ("speaker", "text"):
            t = t.withColumn(c, F.replace(F.col(c), F.lit(tag), F.lit(f"{tag[0]}\\{tag[1:]}")))
    t = t.withColumn("speaker", F.translate("speaker", "\r\n", "  "))
    t = t.groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    who = t.where(~F.col("speaker").isin(*never)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = t.join(who, "conv_id")
    role = F.when(F.col("speaker").isin(*never), F.col("speaker")).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    both = both.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit(open_tag), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))
    tail = close_tag + "\n"
    both = both.withColumn("segment", F.concat(head, "text", F.lit(tail))).withColumn("head_chars", F.length(head)).withColumn("chars", F.length("segment").cast("long"))
    both = both.withColumn("bucket", F.floor(F.col("turn") / TURNS_IN_A_BUCKET))
    placed = running_total(both, ["conv_id", "perspective"], "bucket", ["turn", "speaker", "text"], F.col("chars"), "start")
    mine = F.col("role") == "assistant"
    mine = mine & (F.col("speaker") == F.col("perspective"))
    stop = F.col("start") + F.col("chars")
    return placed.select(
        "conv_id", "perspective", "turn", "role", "name", "segment", "start", stop.alias("stop"),
        F.when(mine, F.col("start") + F.col("head_chars")).alias("mask_start"), F.when(mine, stop - 1).alias("mask_stop"), "copies",
    )


def render(segments: DataFrame, most_chars: int = 4_000_000) -> DataFrame:
    """conv_id, perspective, text, masks (list of start, stop) for dialogues of at most most_chars characters.

    Longer dialogues stay as segments: anti-join the result to find them.
    """
    size = segments.groupBy("conv_id", "perspective").agg(F.max("stop").alias("chars")).where(F.col("chars") <= most_chars)
    kept = segments.join(size, ["conv_id", "perspective"])
    row = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_stop")))
    out = kept.groupBy("conv_id", "perspective").agg(row.alias("s"))
    masks = F.transform(F.filter("s", lambda x: x.mask_start.isNotNull()), lambda x: F.struct(x.mask_start.alias("start"), x.mask_stop.alias("stop")))
    return out.select("conv_id", "perspective", F.array_join(F.col("s.segment"), "").alias("text"), masks.alias("masks"))
