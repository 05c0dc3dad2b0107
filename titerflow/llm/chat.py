"""Chat formatting as a prefix tree: shared first turns are emitted once, depth first, with attention intervals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerflow.llm.common import written
from titerflow.operators.ordering import row_numbers, running_totals

#: The template: turn mark, role, say mark, text, end mark.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings that no text or role may forge: the template's and those of other common templates.
CONTROL = (
    TURN, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|startoftext|>", "<|endoftext|>",
)


def escaped(text: Column) -> Column:
    """``text`` with backslashes doubled and a backslash after the first character of each control string.

    A backslash makes the next character plain, so the step can be undone; no control string holds a
    backslash or starts inside another, so none is left and none arises at the seams.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _md5_chain(keys: Column) -> Column:
    """A name for every prefix of a conversation: the digest of the name before it and the turn."""
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
    return F.aggregate(keys, F.array().cast("array<string>"), lambda acc, k: F.array_append(acc, F.md5(F.concat(last(acc), k).cast("binary"))))


def prefix_tree(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    loss_role: str = "assistant",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All conversations as trees of formatted turns: segments, blocks and conversations.

    Conversations that begin with equal turns (role and text) share these turns.  A tree's stream is its turns
    in depth-first order, each once; lengths and offsets count code points.

    * segments, one per turn of the trees: ``tree, block, offset, length, position`` (position id of the first
      character: the length of all turns above), ``text``, and ``loss_from, loss_to``, the part of the stream
      under the loss mask (equal where there is none);
    * blocks, the turns that one conversation adds: ``tree, block, offset, length, attends``; a character sees
      the intervals of ``attends``, which are exactly its ancestors in other blocks, and its own block up to
      itself;
    * conversations: ``conv_id, n_turns, tree, path``, the intervals of the stream (with their blocks) that
      make it up.

    Conversations are sorted by the digests of their turns; a turn belongs to the first conversation that
    has it, so depth-first order is (rank of that conversation, depth) and offsets are running totals over
    range partitions.  A first turn that a third of all conversations share is one row here, and nothing but
    the turns of one conversation is gathered in a task.

    Null texts and roles count as empty; turns with the same number follow by role and text, a null number
    first; rows with a null ``conv_id`` are one conversation.  Equal conversations share all their turns.  An
    empty table gives empty frames.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")
    ).withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))
    body = escaped(F.col("text"))
    formatted = turns.select(
        "key", F.concat(head, body, F.lit(END)).alias("text"), F.length(head).alias("from"),
        (F.length(head) + F.when(F.col("role") == loss_role, F.length(body)).otherwise(0)).alias("to"),
    )
    texts = written(formatted.groupBy("key").agg(F.any_value(F.struct("text", "from", "to")).alias("s")).select("key", "s.*"))
    sizes = texts.select("key", F.length("text").cast("bigint").alias("length"))
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "by", "key", "length")))
    listed = turns.withColumn("by", F.md5(F.col("text").cast("binary"))).select("conv_id", "turn", "role", "by", "key")
    chains = listed.join(sizes, "key").groupBy("conv_id").agg(order.alias("turns"))
    keys = F.transform("turns", lambda t: t["key"])
    chains = chains.select("conv_id", keys.alias("keys"), F.transform("turns", lambda t: t["length"]).alias("lengths"), _md5_chain(keys).alias("nodes"))
    ranked = written(row_numbers(chains, None, ["keys", "conv_id"], "rank"))
    steps = ranked.select("conv_id", "rank", F.explode(F.arrays_zip("keys", "lengths", "nodes", F.sequence(F.lit(1), F.size("keys")).alias("depth"))).alias("t"))
    steps = steps.select("conv_id", "rank", "t.*")
    own = F.min(F.struct("rank", "depth", "keys", "lengths"))
    nodes = steps.groupBy("nodes").agg(own.alias("n")).select("nodes", F.col("n.rank").alias("block"), F.col("n.depth").alias("depth"), F.col("n.keys").alias("key"), F.col("n.lengths").alias("length"))
    nodes = running_totals(nodes, None, ["block", "depth"], ["length"]).withColumn("at", F.col("cum_length") - F.col("length"))
    nodes = written(nodes.select("nodes", "block", "depth", "key", "length", "at"))
    # Every conversation's way through the stream: a run of turns of one block is one interval.
    way = steps.select("conv_id", "rank", "nodes").join(nodes.drop("key"), "nodes")
    runs = written(
        way.groupBy("conv_id", "rank", "block").agg(
            F.min("depth").alias("depth"), F.min("at").alias("start"), F.max(F.col("at") + F.col("length")).alias("stop"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    paths = runs.groupBy("conv_id", "rank").agg(
        F.array_sort(F.collect_list(F.struct("depth", "block", "start", "stop"))).alias("runs"), F.sum("n").alias("n_turns")
    )
    # A tree begins at the offset of its first turn.
    paths = written(paths.withColumn("tree", F.col("runs")[0]["block"]))
    roots = nodes.where("depth = 1").select(F.col("block").alias("tree"), F.col("at").alias("base"))
    paths = written(paths.join(roots, "tree"))
    shifted = lambda r, base: F.struct(r["block"].alias("block"), (r["start"] - base).alias("start"), (r["stop"] - base).alias("stop"))
    conversations = paths.select(
        "conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "tree", F.transform("runs", lambda r: shifted(r, F.col("base"))).alias("path")
    )
    adding = paths.where(F.element_at("runs", -1)["block"] == F.col("rank"))
    before = F.filter("runs", lambda r: r["block"] != F.col("rank"))
    added = F.element_at("runs", -1)
    blocks = adding.select(
        "tree", F.col("rank").alias("block"), (added["start"] - F.col("base")).alias("offset"), (added["stop"] - added["start"]).alias("length"),
        F.transform(before, lambda r: F.struct((r["start"] - F.col("base")).alias("start"), (r["stop"] - F.col("base")).alias("stop"))).alias("attends"),
    )
    blocks = written(blocks)
    seen = F.aggregate("attends", F.lit(0).cast("bigint"), lambda a, r: a + r["stop"] - r["start"])
    frame = blocks.select("tree", "block", F.col("offset").alias("block_offset"), seen.alias("seen"))
    firsts = nodes.groupBy("block").agg(F.min("at").alias("block_at"))
    segments = nodes.join(firsts, "block").join(frame, "block").join(texts, "key")
    offset = F.col("block_offset") + F.col("at") - F.col("block_at")
    segments = segments.select(
        "tree", "block", offset.alias("offset"), "length", (F.col("seen") + F.col("at") - F.col("block_at")).alias("position"), "text",
        (offset + F.col("from")).alias("loss_from"), (offset + F.col("to")).alias("loss_to"),
    )
    return segments, blocks, conversations


def read_back(segments: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, loss`` from the streams alone: each conversation's characters, its turns
    ``(role, text)`` parsed from them and unescaped, and its unescaped texts under the loss mask, in order."""
    ways = conversations.select("conv_id", F.explode("path").alias("p")).select("conv_id", "p.*")
    part = segments.select(F.col("block").alias("own"), "offset", "position", "text", "loss_from", "loss_to")
    pieces = ways.join(part, (F.col("block") == F.col("own")) & (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("stop")))
    masked = F.when(
        F.col("loss_to") > F.col("loss_from"),
        F.substring("text", (F.col("loss_from") - F.col("offset") + 1).cast("int"), (F.col("loss_to") - F.col("loss_from")).cast("int")),
    )
    whole = pieces.withColumn("masked", masked).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "text", "masked"))).alias("p")
    )
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    loss = F.transform(F.filter("p", lambda x: x["masked"].isNotNull()), lambda x: unescaped(x["masked"]))
    turn = lambda x: F.struct(
        unescaped(F.replace(F.substring_index(x, SAYS, 1), F.lit(TURN), F.lit(""))).alias("role"),
        unescaped(F.substring_index(x, SAYS, -1)).alias("text"),
    )
    parts = F.filter(F.split("formatted", r"\Q" + END + r"\E"), lambda x: x != "")
    return whole.select("conv_id", text.alias("formatted"), loss.alias("loss")).select(
        "conv_id", "formatted", F.transform(parts, turn).alias("turns"), "loss"
    )
