"""Chat formatting into prefix trees.

Conversations that share their first turns are merged: a node is a turn with all
turns before it. Each tree is emitted depth-first, so shared tokens occur once;
a node has its place in the tree (start), its position ids (position, counted
from the conversation's start) and the intervals of the tree that it may attend
to besides itself (attends: its ancestors, neighbours merged).

Order: distinct conversations, as arrays of turn digests, are sorted over range
partitions; a node belongs to the first of them that has it. This is depth-first
order, and no task ever holds a tree: a tree that a third of all conversations
share is cut over partitions like any other run of the order.

Template: `<|role|>` newline, escaped text, `<|end|>` newline. Escaping puts a
backslash inside each control string of a text (see CONTROL) and doubles
backslashes, and is undone exactly by unescape.

Rules: turns by number (nulls first), ties by role, then by digest; repeated
rows are turns of their own. Null text or role counts as empty. A null conv_id
is one conversation. Only assistant text is under the loss mask.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import as_batch, blocks, cut

#: A character that begins a control string, where the rest follows: template markers and those of common other templates.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])|\|(?=>)"
#: Distinct conversations in a run of the depth-first order, which one window adds up, and runs in a stretch of it.
RUN, STRETCH = 32, 4096
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", "$1\\\\")


def escape_text(text: str) -> str:
    return re.sub(f"({CONTROL})", r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest (16 bytes of role and text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.substring(F.unhex(F.sha2(both, 256)), 1, 16).alias("digest"))


def paths_of(turns: DataFrame) -> DataFrame:
    """conv_id and path: the digests of its turns in order. Texts stay behind."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "digest")), lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: t["digest"]).alias("path"))


def chain(path: list[bytes]) -> list[bytes]:
    """An id for each prefix of the path."""
    out, last = [], b""
    for d in path:
        last = sha256(last + d).digest()[:16]
        out.append(last)
    return out


def shared(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


VISIT = pa.schema([("leaf", pa.binary()), ("place", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("tree", pa.binary()), ("digest", pa.binary()), ("fresh", pa.bool_())])


def walk(paths: DataFrame) -> DataFrame:
    """A row for each (distinct path, depth): the node there, and whether the path is the first to reach it.

    place numbers the distinct paths in depth-first order. Columns: leaf (the path's last node), place, depth,
    node, tree (the root), digest, fresh.
    """
    spark = paths.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(paths.select("path").distinct().repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()))
    # one row a partition: where it begins, and the path before its first
    ends = ordered.groupBy("part").agg(F.max("path").alias("last"), F.count(F.lit(1)).alias("n"))
    by_part = Window.orderBy("part")
    carry = ends.select("part", F.lag("last").over(by_part).alias("before"), F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    shared_carry = spark.sparkContext.broadcast({r["part"]: ([bytes(x) for x in r["before"] or []], r["base"]) for r in carry.collect()})

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, part = None, 0, None
        for b in batches:
            out = [[] for _ in VISIT]
            for path, p in zip(b.column("path").to_pylist(), b.column("part").to_pylist(), strict=True):
                if p != part:
                    part, (last, place) = p, shared_carry.value[p]
                nodes, known = chain(path), shared(path, last)
                for depth, (node, digest) in enumerate(zip(nodes, path, strict=True)):
                    for column, value in zip(out, (nodes[-1], place, depth, node, nodes[0], digest, depth >= known), strict=True):
                        column.append(value)
                last, place = path, place + 1
            yield as_batch(VISIT, *out)

    return ordered.mapInArrow(visit, "leaf binary, place long, depth int, node binary, tree binary, digest binary, fresh boolean")


@lru_cache(maxsize=2)
def byte_tokenizer(path: str):
    """A byte-level tokenizer from a file of ranks (token in base 64 and id on each line); one a worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


def tokenized(texts: DataFrame, path: str) -> DataFrame:
    """digest, role, segment, loss_start, loss_end and tokens of distinct turns."""
    head = F.length(F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))).cast("long")
    stop = (F.length("segment") - len(CLOSE)).cast("long")
    spoken = F.col("role") == "assistant"
    ready = texts.withColumn("segment", segment(F.col("role"), F.col("text"))).select("digest", "role", "segment", F.when(spoken, head).alias("loss_start"), F.when(spoken, stop).alias("loss_end"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(path)
        for b in blocks(batches, "segment", 2 << 20):
            # control strings in texts are escaped, others are text
            ids = [tokenizer.encode_ordinary(s) for s in b.column("segment").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "tokens"])

    return ready.mapInArrow(encode, "digest binary, role string, segment string, loss_start long, loss_end long, tokens array<int>")


def before(*keys: str) -> WindowSpec:
    """All rows before the current one in an order by the last of the keys, within the others."""
    return Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)


def starts_of_runs(own: DataFrame) -> DataFrame:
    """tree, run, base: the tokens of the tree before the run. own: tree, run and n of all nodes.

    Totals of stretches of runs are added up first, so a tree of 10**9 distinct conversations is a window of a few thousand rows.
    """
    runs = own.groupBy("tree", "run").agg(F.sum("n").alias("n")).withColumn("stretch", F.floor(F.col("run") / STRETCH))
    runs = cut(runs)
    whole = runs.groupBy("tree", "stretch").agg(F.sum("n").alias("n"))
    stretches = whole.select("tree", "stretch", F.coalesce(F.sum("n").over(before("tree", "stretch")), F.lit(0)).alias("stretch_base"))
    within = runs.withColumn("base", F.coalesce(F.sum("n").over(before("tree", "stretch", "run")), F.lit(0)))
    return within.join(stretches, ["tree", "stretch"]).select("tree", "run", (F.col("stretch_base") + F.col("base")).alias("base"))


def with_ancestors(seen: DataFrame) -> DataFrame:
    """Adds attends to the nodes along paths (leaf, depth, start, stop): the intervals of all nodes above, neighbours merged.

    A node continues the interval of its parent where it begins at the parent's stop. Only where it does not, an interval is
    closed, and only closed intervals are gathered: a chain of any length has one.
    """
    along = Window.partitionBy("leaf").orderBy("depth")
    above = along.rowsBetween(Window.unboundedPreceding, -1)
    linked = seen.withColumn("parent_stop", F.lag("stop").over(along))
    linked = linked.withColumn("breaks", F.coalesce(F.col("start") != F.col("parent_stop"), F.lit(False)))
    linked = linked.withColumn("opened", F.last(F.when(F.col("breaks") | F.col("parent_stop").isNull(), F.col("start")), ignorenulls=True).over(above))
    current = F.struct(F.col("opened").alias("start"), F.col("parent_stop").alias("stop"))
    closed = F.collect_list(F.when(F.col("breaks"), current)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    goes_on = ~F.col("breaks") & F.col("parent_stop").isNotNull()
    return linked.withColumn("attends", F.when(goes_on, F.concat(closed, F.array(current))).otherwise(closed)).drop("parent_stop", "breaks", "opened")


def build_trees(conversations: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves).

    nodes: tree, node, parent, depth, role, segment, loss_start, loss_end (code points of segment), tokens,
    start (place of its first token in the tree), position (position id of its first token), attends.
    leaves: conv_id and the visits of its path, as (conv_id, depth, node).
    """
    turns = turns_of(conversations)
    paths = cut(paths_of(turns))
    visits = cut(walk(paths))
    texts = cut(tokenized(turns.groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text")), path))
    sized = visits.join(texts.select("digest", F.size("tokens").cast("long").alias("n")), "digest")

    # depth-first places: totals of runs of the order give each run its start, a window inside the run does the rest
    own = sized.where("fresh").withColumn("run", F.floor(F.col("place") / RUN))
    inside = Window.partitionBy("tree", "run").orderBy("place", "depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(own.join(starts_of_runs(own), ["tree", "run"]).select("node", "n", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start")))

    # along each path: positions and ancestors; a node takes them from the first path that reaches it
    seen = visits.join(placed, "node").withColumn("stop", F.col("start") + F.col("n")).withColumn("position", F.coalesce(F.sum("n").over(before("leaf", "depth")), F.lit(0)))
    seen = with_ancestors(seen.withColumn("parent", F.lag("node").over(Window.partitionBy("leaf").orderBy("depth"))))
    nodes = seen.where("fresh").join(texts, "digest")
    nodes = nodes.select("tree", "node", "parent", "depth", "role", "segment", "loss_start", "loss_end", "tokens", "start", "position", "attends")

    steps = paths.withColumn("steps", path_nodes()(F.col("path"))).select("conv_id", F.posexplode("steps").alias("depth", "node"))
    return nodes, steps


def path_nodes():
    """A function of a path column that gives the node ids along it."""

    @F.pandas_udf("array<binary>")
    def nodes(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: chain([bytes(x) for x in p]))

    return nodes


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("end_position", pa.int64()), ("attended", pa.int64())])
READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, end_position long, attended long"


class Transcript:
    """What is read back of one conversation, node by node."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss, self.chars, self.tokens, self.end, self.attended = conv_id, 0, 0, 0, 0, 0, 0
        self.said, self.spoken = sha256(), sha256()

    def add(self, seg: str, start: int | None, stop: int | None, tokens: int, position: int, attended: int) -> None:
        for role, text in TURN.findall(seg):
            self.turns += 1
            self.said.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        if start is not None:
            spoken = unescape(seg[start:stop])
            self.loss += len(spoken)
            self.spoken.update(spoken.encode())
        self.chars += len(seg)
        self.tokens += tokens
        self.end, self.attended = position + tokens, attended

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss, self.spoken.hexdigest(), self.chars, self.tokens, self.end, self.attended


def read_back(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Digests of each conversation, from the nodes on its path alone: the output is parsed and unescaped.

    end_position follows its last position id; attended counts the tokens that its last node attends to besides
    itself. A conversation is hashed turn by turn as its sorted rows go by, so its length does not matter.
    """
    attended = F.aggregate("attends", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("attended")
    own = nodes.select("node", "segment", "loss_start", "loss_end", F.size("tokens").alias("n_tokens"), "position", attended)
    rows = steps.join(own, "node").drop("node")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for conv, *rest in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end", "n_tokens", "position", "attended")), strict=True):
                if now is None or now.conv_id != conv:
                    done += [now.row()] if now else []
                    now = Transcript(conv)
                now.add(*rest)
            yield as_batch(READ, *(map(list, zip(*done, strict=True)) if done else [[] for _ in READ]))
        if now:
            yield as_batch(READ, *([x] for x in now.row()))

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(digest, READ_DDL)


def position_ids(node: dict) -> np.ndarray:
    """Position ids of a node's tokens."""
    return np.arange(node["position"], node["position"] + len(node["tokens"]))
