"""Conversations as prefix trees: shared first turns are written once.

Distinct conversations are sorted by the hashes of their turns, so those with a common
beginning stand together; each task goes through its range depth first and writes blocks of
bounded size.  A block is a forest: its text has every turn once, after the turns it follows,
and each turn's segment says where its positions begin and which intervals it may attend to.
A tree that is larger than a block goes on in the next one, with the path to it repeated.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.llm.common import durable, partitions

OPEN, CLOSE = "### ", "</turn>\n"
_SPAN = "array<struct<start:long,end:long>>"
SEGMENT = (
    "struct<start:long,end:long,parent:int,position:long,loss_start:long,loss_end:long,"
    f"attends:{_SPAN}>"
)
BLOCK_SCHEMA = (
    f"block_id string, text string, segments array<{SEGMENT}>, "
    "leaves array<struct<leaf:string,segment:int>>"
)
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*): (.*)</turn>\n\Z", re.S)


def escape(text):
    """Backslashes and control strings of a text get a backslash in front (a Column)."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each turn's formatted text, ordered by turn.

    NULL roles and texts are empty.  Rows of one conversation with equal turn numbers are
    ordered by role and text; repeated rows are turns of their own; rows without a
    ``conv_id`` make up one conversation.  Other columns are not read.  Texts of any length are
    formatted whole; the turns of one conversation are one row.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return listed.select(
        "conv_id",
        F.transform(
            "rows",
            lambda r: F.concat(
                F.lit(OPEN),
                F.replace(escape(r["role"]), F.lit(":"), F.lit("\\:")),
                F.lit(": "),
                escape(r["text"]),
                F.lit(CLOSE),
            ),
        ).alias("turns"),
    )


def members_of(formatted: DataFrame) -> DataFrame:
    """``(conv_id, leaf)``: the distinct conversation that each one is a copy of."""
    return formatted.select("conv_id", _leaf())


def _leaf():
    return F.sha2(F.array_join("turns", ""), 256).alias("leaf")


def prefix_blocks(formatted: DataFrame, *, block_chars: int = 1 << 16) -> DataFrame:
    """Blocks of at most ``block_chars`` characters, or of one longer conversation.

    ``segments`` has for each turn of the block its span in ``text``, the segment it follows
    (-1: none), the position of its first character, the span that counts towards the loss
    (of assistant turns, else empty) and the intervals that it attends to: its ancestors and
    itself.  ``leaves`` names the segment at which each distinct conversation ends.
    """
    distinct = formatted.select(_leaf(), "turns").groupBy("leaf").agg(
        F.first("turns").alias("turns")
    )
    path = F.transform("turns", lambda t: F.xxhash64(t))
    spread = (
        distinct.withColumn("path", path)
        .repartitionByRange(partitions(formatted.sparkSession), "path", "leaf")
        .sortWithinPartitions("path", "leaf")
        .select("leaf", "turns")
    )

    def build(batches):
        block, ready, size = _Block(), [], 0
        for batch in batches:
            for leaf, turns in zip(
                batch.column("leaf").to_pylist(), batch.column("turns").to_pylist()
            ):
                if block.leaves and block.length + block.growth(turns) > block_chars:
                    ready.append(block.row())
                    size += block.length
                    block = _Block()
                    if size >= 4 << 20:
                        yield _blocks(ready)
                        ready, size = [], 0
                block.add(leaf, turns)
        if block.leaves:
            ready.append(block.row())
        if ready:
            yield _blocks(ready)

    return spread.mapInArrow(build, BLOCK_SCHEMA)


class _Block:
    def __init__(self):
        self.parts, self.segments, self.leaves = [], [], []
        self.path, self.length = [], 0  # path: (turn, segment) of the last conversation

    def _shared(self, turns):
        n = 0
        while n < min(len(turns), len(self.path)) and turns[n] == self.path[n][0]:
            n += 1
        return n

    def growth(self, turns):
        return sum(map(len, turns[self._shared(turns) :]))

    def add(self, leaf, turns):
        del self.path[self._shared(turns) :]
        for turn in turns[len(self.path) :]:
            parent = self.path[-1][1] if self.path else -1
            above = self.segments[parent] if self.path else None
            start, end = self.length, self.length + len(turn)
            position = above["position"] + above["end"] - above["start"] if above else 0
            attends = [dict(s) for s in above["attends"]] if above else []
            if attends and attends[-1]["end"] == start:
                attends[-1]["end"] = end
            else:
                attends.append({"start": start, "end": end})
            inner = (end, end)
            if turn.startswith(f"{OPEN}assistant: "):
                inner = (start + len(f"{OPEN}assistant: "), end - len(CLOSE))
            self.segments.append(
                {
                    "start": start, "end": end, "parent": parent, "position": position,
                    "loss_start": inner[0], "loss_end": inner[1], "attends": attends,
                }
            )
            self.path.append((turn, len(self.segments) - 1))
            self.parts.append(turn)
            self.length = end
        self.leaves.append({"leaf": leaf, "segment": self.path[-1][1] if self.path else -1})

    def row(self):
        return {
            "block_id": self.leaves[0]["leaf"], "text": "".join(self.parts),
            "segments": self.segments, "leaves": self.leaves,
        }


_PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PA_BLOCK = pa.schema(
    [
        ("block_id", pa.string()),
        ("text", pa.string()),
        (
            "segments",
            pa.list_(
                pa.struct(
                    [
                        ("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()),
                        ("position", pa.int64()), ("loss_start", pa.int64()),
                        ("loss_end", pa.int64()), ("attends", _PA_SPANS),
                    ]
                )
            ),
        ),
        ("leaves", pa.list_(pa.struct([("leaf", pa.string()), ("segment", pa.int32())]))),
    ]
)


def _blocks(rows):
    return pa.RecordBatch.from_pylist(rows, schema=_PA_BLOCK)


def position_ids(segments) -> list[int]:
    """The position of every character of a block, from its segments."""
    return [s["position"] + k for s in segments for k in range(s["end"] - s["start"])]


def read_leaves(blocks: DataFrame) -> DataFrame:
    """What each distinct conversation says, read back from the blocks' text and segments.

    ``(leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.
    """
    schema = (
        "leaf string, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches):
        for batch in batches:
            rows = []
            for block in batch.to_pylist():
                text, segments = block["text"], block["segments"]
                for leaf in block["leaves"]:
                    rows.append((leaf["leaf"], *_read_leaf(text, segments, leaf["segment"])))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows)))))

    return blocks.mapInArrow(read, schema)


def _read_leaf(text, segments, at):
    path = []
    while at >= 0:
        path.append(segments[at])
        at = segments[at]["parent"]
    path.reverse()
    said, loss, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
    for s in path:
        role, inner = _TURN.match(text[s["start"] : s["end"]]).groups()
        said.update(f"{unescape(role)}\n{unescape(inner)}\n".encode())
        learnt = unescape(text[s["loss_start"] : s["loss_end"]])
        loss.update(learnt.encode())
        loss_chars += len(learnt)
        chars += s["end"] - s["start"]
    return len(path), said.hexdigest(), loss_chars, loss.hexdigest(), chars


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    formatted = format_turns(rows.select("conv_id", "turn", "role", "text").unionByName(extra))
    read = read_leaves(durable(prefix_blocks(formatted)))
    return members_of(formatted).join(read, "leaf").select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


OP10_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                     (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'),
                      '</turn>', '\</turn>') AS t,
           replace(replace(replace(replace(role, '\', '\\'), '###', '\###'),
                   '</turn>', '\</turn>'), ':', '\:') AS r
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
           FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(t) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
