"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: each distinct prefix
is a node, and each tree (one per distinct first turn) lays its nodes out depth
first, every shared turn once.  A conversation's row holds the turns that it
adds, their place in the tree's layout, the position ids, and the intervals of
its ancestors in the layout, to which alone its tokens attend besides their own
predecessors in the segment.  A token is a code point here.

Conversations are sorted by the chain of digests of their turns, which is depth
first; each task then works through its range with a stack.  What a range needs
from those before it (the path that it enters on) follows from one summary per
range, so that a tree that holds most conversations is dealt over many tasks.

Template of a turn: ``<turn>role NEWLINE text</turn> NEWLINE``.  In roles and
texts a backslash becomes two, ``<`` becomes backslash l, and in roles a newline
becomes backslash n; so no control string can stand inside a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import ROWS, checkpointed, map_rows, written

OPEN, CLOSE = "<turn>", "</turn>\n"
DIGEST = 16
#: Conversations of a range, about.
RANGE = 100_000
_BACK = {"\\": "\\", "l": "<", "n": "\n"}
_ESCAPE = re.compile(r"\\(.)")

_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PART = pa.list_(pa.struct([("segment", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_TURN = pa.list_(pa.struct([("text", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))
_CONV = pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("turns", _TURN)])
_ROW = pa.schema([("tree_id", pa.string()), ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("shared_turns", pa.int64()), ("start", pa.int64()), ("position", pa.int64()), ("text", pa.string()), ("loss", _SPAN), ("attends", _PART)])
_ROW_DDL = "tree_id string, conv_id long, n_turns long, shared_turns long, start long, position long, text string, loss array<struct<start:long,end:long>>, attends array<struct<segment:long,start:long,end:long>>"


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<", "\\l")
    return out.replace("\n", "\\n") if role else out


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _BACK[m[1]], text) if "\\" in text else text


def render(role: str, text: str, trained: str) -> tuple[str, int, int]:
    """A turn, and where in it the text stands that is trained on; (-1, -1) if none is."""
    head, body = OPEN + escape(role, True) + "\n", escape(text)
    span = (len(head), len(head) + len(body)) if role == trained else (-1, -1)
    return head + body + CLOSE, *span


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for x in formatted.split(CLOSE)[:-1]:
        role, _, text = x[len(OPEN) :].partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


def _common(a: bytes, b: bytes) -> int:
    n = 0
    for i in range(0, min(len(a), len(b)), DIGEST):
        if a[i : i + DIGEST] != b[i : i + DIGEST]:
            break
        n += 1
    return n


class _Walk:
    """The path to the conversation just passed: digests, and each node's start and segment in the layout."""

    def __init__(self, path: bytes = b"", starts: list[int] | None = None, segments: list[int] | None = None, cursor: int = 0):
        self.path, self.starts, self.segments, self.cursor = path, starts or [], segments or [], cursor

    def step(self, path: bytes, lengths: list[int]) -> int:
        """Moves on to a conversation; returns how many turns it shares with the path."""
        shared = _common(self.path, path)
        if not shared:
            self.cursor = 0
        del self.starts[shared:], self.segments[shared:]
        segment = self.cursor
        for n in lengths[shared:]:
            self.starts.append(self.cursor)
            self.segments.append(segment)
            self.cursor += n
        self.path = path
        return shared

    def ancestors(self, shared: int, lengths: list[int]) -> list[dict]:
        """Intervals of the shared turns, those joined that adjoin in one segment."""
        out: list[dict] = []
        for at, seg, n in zip(self.starts[:shared], self.segments[:shared], lengths, strict=False):
            if out and out[-1]["segment"] == seg and out[-1]["end"] == at:
                out[-1]["end"] += n
            else:
                out.append({"segment": seg, "start": at, "end": at + n})
        return out


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task's range: its first and last path and where the walk stands after it."""
    walk, first, first_lengths = _Walk(), None, []
    for batch in batches:
        for r in batch.to_pylist():
            lengths = [len(t["text"]) for t in r["turns"]]
            if first is None:
                first, first_lengths = r["path"], lengths
            walk.step(r["path"], lengths)
    if first is not None:
        row = {"part": TaskContext.get().partitionId(), "first": first, "lengths": first_lengths, "last": walk.path, "starts": walk.starts, "segments": walk.segments, "cursor": walk.cursor}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int64()), ("first", pa.binary()), ("lengths", pa.list_(pa.int64())), ("last", pa.binary()), ("starts", pa.list_(pa.int64())), ("segments", pa.list_(pa.int64())), ("cursor", pa.int64())]))


def _enter(summaries: list) -> dict[int, tuple[bytes, list[int], list[int], int]]:
    """The path, cut to what the range shares with it, on which each range enters."""
    out, walk = {}, _Walk()
    for s in sorted(summaries, key=lambda r: r.part):
        first, last = bytes(s.first), bytes(s.last)
        shared = _common(walk.path, first)
        entered, starts, segments, cursor = walk.path[: shared * DIGEST], walk.starts[:shared], walk.segments[:shared], walk.cursor
        out[s.part] = (entered, starts, segments, cursor)
        if shared and last[:DIGEST] == first[:DIGEST]:
            # Within the tree entered on, all of the range's own places move by as much.
            move, kept = cursor - sum(s.lengths[:shared]), min(shared, _common(first, last))
            own = [x + move for x in s.starts[kept:]]
            # The first conversation's segment begins where its own turns begin.
            of = [cursor if x == 0 else x + move for x in s.segments[kept:]]
            walk = _Walk(last, starts[:kept] + own, segments[:kept] + of, s.cursor + move)
        else:
            walk = _Walk(last, list(s.starts), list(s.segments), s.cursor)
    return out


def prefix_trees(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """Formats conversations (conv_id, turn, role, text) as prefix trees.

    Returns per conversation: tree_id, conv_id, n_turns, shared_turns (turns that
    stand in the tree already), start (of its own text in the layout; also its
    segment's name), position (position id of its first own token; they count
    on by one), text, loss (intervals of the layout to train on among its own
    text: the escaped texts of turns whose role is ``trained``), attends
    (ancestors' intervals, each with the segment that holds it).

    Turns are ordered by turn, then role and text; null roles and texts are
    empty, a null turn comes first, rows without conv_id are one conversation;
    a copy of a conversation has no text of its own.  A conversation is one row,
    so its turns must fit in a task's memory; a range has about ``RANGE`` of them at most.  Other columns don't matter; an
    empty table gives no row.
    """
    turn = F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def shape(rows: dict[str, list]) -> dict[str, list]:
        paths, turns = [], []
        for t in rows["t"]:
            chain, path, out = b"", bytearray(), []
            for x in t:
                text, a, b = render(x["role"], x["text"], trained)
                chain = hashlib.blake2b(chain + text.encode(), digest_size=DIGEST).digest()
                path += chain
                out.append({"text": text, "a": a, "b": b})
            paths.append(bytes(path))
            turns.append(out)
        return {"conv_id": rows["conv_id"], "path": paths, "turns": turns}

    convs = written(map_rows(grouped, shape, _CONV, "conv_id long, path binary, turns array<struct<text:string,a:long,b:long>>"), "conversations")
    parts = max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), convs.count() // RANGE + 1)
    ordered = checkpointed(convs.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id"))
    # One row per range comes to the driver, and goes to every task: a path of digests and places for each range.
    enter = _enter(ordered.mapInArrow(_summary, "part long, first binary, lengths array<long>, last binary, starts array<long>, segments array<long>, cursor long").collect())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, starts, segments, cursor = enter.get(TaskContext.get().partitionId(), (b"", [], [], 0))
        walk = _Walk(path, list(starts), list(segments), cursor)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = []
                for r in batch.slice(at, ROWS).to_pylist():
                    lengths = [len(t["text"]) for t in r["turns"]]
                    shared = walk.step(r["path"], lengths)
                    start = walk.starts[shared] if shared < len(lengths) else walk.cursor
                    loss = [{"start": walk.starts[i] + t["a"], "end": walk.starts[i] + t["b"]} for i, t in enumerate(r["turns"]) if i >= shared and t["a"] >= 0]
                    out.append({"tree_id": r["path"][:DIGEST].hex(), "conv_id": r["conv_id"], "n_turns": len(lengths), "shared_turns": shared, "start": start, "position": sum(lengths[:shared]), "text": "".join(t["text"] for t in r["turns"][shared:]), "loss": loss, "attends": walk.ancestors(shared, lengths)})
                yield pa.RecordBatch.from_pylist(out, schema=_ROW)

    return ordered.mapInArrow(emit, _ROW_DDL)


def read_back(trees: DataFrame) -> DataFrame:
    """Conversations from prefix trees: conv_id, formatted, trained (the unescaped trained texts, joined).

    A segment is one row on the right side of the join, so where most
    conversations share one, adaptive execution may split the left side.
    """
    own = F.struct(F.col("start").alias("segment"), F.col("start"), (F.col("start") + F.length("text")).alias("end"))
    parts = trees.select("conv_id", "tree_id", F.posexplode(F.concat("attends", F.array(own))).alias("at", "part"))
    parts = parts.select("conv_id", "tree_id", "at", F.col("part.segment").alias("segment"), F.col("part.start").alias("from"), F.col("part.end").alias("to"))
    texts = trees.where(F.length("text") > 0).select("tree_id", F.col("start").alias("segment"), "text", "loss")
    # A conversation without own text keeps its last, empty part.
    joined = parts.join(texts, ["tree_id", "segment"], "left").select(
        "conv_id",
        F.struct(
            "at",
            F.coalesce(F.expr("substring(text, cast(`from` - segment + 1 as int), cast(`to` - `from` as int))"), F.lit("")).alias("text"),
            F.coalesce(F.expr("transform(filter(loss, x -> x.start >= `from` and x.end <= `to`), x -> struct(x.start - `from` as start, x.end - `from` as end))"), F.expr("cast(array() as array<struct<start:long,end:long>>)")).alias("loss"),
        ).alias("p"),
    )
    whole = joined.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def join(rows: dict[str, list]) -> dict[str, list]:
        return {
            "conv_id": rows["conv_id"],
            "formatted": ["".join(x["text"] for x in p) for p in rows["p"]],
            "trained": ["".join(unescape(x["text"][s["start"] : s["end"]]) for x in p for s in x["loss"]) for p in rows["p"]],
        }

    return map_rows(whole, join, pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("trained", pa.string())]), "conv_id long, formatted string, trained string")


def digests(trees: DataFrame) -> DataFrame:
    """Counts and digests of conversations read back from prefix trees."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(rows: dict[str, list]) -> dict[str, list]:
        turns = [parse(x) for x in rows["formatted"]]
        return {
            "conv_id": rows["conv_id"],
            "n_turns": [len(t) for t in turns],
            "turns_sha256": [hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest() for t in turns],
            "loss_chars": [len(x) for x in rows["trained"]],
            "loss_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in rows["trained"]],
            "formatted_chars": [len(x) for x in rows["formatted"]],
        }

    return map_rows(read_back(trees), run, schema, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
