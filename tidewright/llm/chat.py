"""Chat formatting as prefix trees.

Conversations that share their first turns share nodes: a node is a turn behind all turns before it, named by
a digest of both, and its formatted text and tokens come out once. Nodes lie depth-first in their tree, siblings
by digest; each has its place there, the position id of its first token (what its ancestors hold) and the
intervals of its ancestors, which are what its tokens may attend to besides earlier tokens of their own node.

A task that reads conversations puts out each node's text and tokens once; of a node that several tasks put out one
row stays, and the path it came with owns it. What a path owns is always its end, from some depth on. Places need
no tree in one task, nor any text: subtree sizes are sums over paths of the lengths that they own, what lies left
of a node among its siblings is a prefix sum in two levels, and a path places the nodes that it owns.
"""

from __future__ import annotations

import hashlib
import re

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, broadcast_if_small, discard, map_slices, materialise, ship_package, table

BEGIN, USER, END_USER, END, OTHER, END_OTHER = "<s>", "[INST] ", " [/INST]", " </s>", "<<SYS>>", "<</SYS>>"
CONTROL = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>")
#: Nodes that a task remembers at once, to put them out once.
SEEN = 500_000


def escape(text: str) -> str:
    """A text without control strings: a backslash is doubled, a control string's first character becomes \\l or \\b."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else ("\\l" if m[0][0] == "<" else "\\b") + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "l": "<", "b": "[", "n": "\n"}[m[1]], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, the escaped text, and what stands behind."""
    if role == "user":
        return USER, escape(text), END_USER
    if role == "assistant":
        return " ", escape(text), END
    role = escape(role).replace("\n", "\\n")
    return f"{OTHER}{role}\n", escape(text), END_OTHER


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. ValueError if it isn't one."""
    if not formatted.startswith(BEGIN):
        raise ValueError("no begin")
    at, turns = len(BEGIN), []
    while at < len(formatted):
        if formatted.startswith(USER, at):
            start, mark, role = at + len(USER), END_USER, "user"
        elif formatted.startswith(OTHER, at):
            start = formatted.index("\n", at) + 1
            mark, role = END_OTHER, unescape(formatted[at + len(OTHER) : start - 1])
        elif formatted.startswith(" ", at):
            start, mark, role = at + 1, END, "assistant"
        else:
            raise ValueError("no turn")
        end = formatted.index(mark, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(mark)
    return turns


CONTENT = "node_id binary, parent_id binary, owner binary, depth int, role string, segment string, ids binary, length bigint, loss_from bigint, loss_to bigint, loss_from_char bigint, loss_to_char bigint"


def _read(conversations: DataFrame, files: tuple | None) -> DataFrame:
    """kind 0: a row for each conversation: conv_id, n_turns, leaf_id, path (its nodes' ids, 16 bytes each) and lengths.
    kind 1: nodes, each once in a task, numbered by `at` in the order of tasks and rows, with the leaf of the path they came with."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.withColumn("__alone", alone).groupBy("conv_id", "__alone").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", "turns")
    schema = "kind int, conv_id bigint, n_turns bigint, leaf_id binary, path binary, lengths binary, at bigint, " + CONTENT
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    bound_batches(conversations.sparkSession)
    ship_package(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        if files:
            from .bpe import BytePairEncoder

            encode = BytePairEncoder(*files, escape=True).encode
        seen: dict[bytes, int] = {}  # nodes put out, with their lengths
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out: dict[str, list] = {n: [] for n in names}

                def put(out=out, **row) -> None:
                    for n in names:
                        out[n].append(row.get(n))

                part = batch.slice(i, 64)
                todo = []  # (conv_id, path, nodes that it puts out)
                fresh: dict[bytes, int] = {}  # nodes of this slice by their place in texts
                texts: list[str] = []
                for conv_id, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    above, path, new = None, [], []
                    for depth, t in enumerate(turns):
                        own = hashlib.blake2b(above or b"", digest_size=16)
                        for x in (t["role"].encode("utf-8", "surrogatepass"), t["text"].encode("utf-8", "surrogatepass")):
                            own.update(len(x).to_bytes(8, "little") + x)
                        node = own.digest()
                        path.append(node)
                        if node not in seen and node not in fresh:
                            before, body, after = format_turn(t["role"], t["text"])
                            fresh[node] = len(texts)
                            texts += [BEGIN + before if above is None else before, body, after]
                            new.append((node, above, depth, t["role"]))
                        above = node
                    todo.append((conv_id, path, new))
                ids = encode(texts) if encode and texts else None
                sizes = [len(x) // 4 for x in ids] if ids else [len(x) for x in texts]
                for node, k in fresh.items():
                    seen[node] = sum(sizes[k : k + 3])
                for conv_id, path, new in todo:
                    put(kind=0, conv_id=conv_id, n_turns=len(path), leaf_id=path[-1], path=b"".join(path), lengths=np.array([seen[x] for x in path], dtype="<i8").tobytes())
                    for node, above, depth, role in new:
                        k, loss = fresh[node], role == "assistant"
                        put(
                            kind=1, at=at, node_id=node, parent_id=above, owner=path[-1], depth=depth, role=role, segment="".join(texts[k : k + 3]), ids=b"".join(ids[k : k + 3]) if ids else None, length=seen[node],
                            loss_from=sizes[k] if loss else 0, loss_to=sizes[k] + sizes[k + 1] if loss else 0,
                            loss_from_char=len(texts[k]) if loss else 0, loss_to_char=len(texts[k]) + len(texts[k + 1]) if loss else 0,
                        )
                        at += 1
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names=names)
                if len(seen) > SEEN:
                    seen.clear()

    return rows.mapInArrow(run, schema)


def _split(path: bytes) -> list[bytes]:
    return [path[i : i + 16] for i in range(0, len(path), 16)]


def prefix_trees(conversations: DataFrame, files: tuple | None = None, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """conversations(conv_id, turn, role, text) -> (nodes, members).

    nodes: tree_id, node_id, parent_id (null at a root), owner (the leaf of a path through it), depth, role, segment
    (formatted text), ids (of the tokenizer `files`, see BytePairEncoder; null without), length in tokens (code
    points without a tokenizer), start (place in the tree, depth-first), position (of its first token in a
    conversation), ancestors (merged intervals of places, in order), loss_from and loss_to (tokens in the node that
    are trained on: the texts of assistants), loss_from_char and loss_to_char (the same in code points of segment).
    members: conv_id, n_turns, tree_id, leaf_id, path (node_ids, root first).

    Rows of a conversation go by turn; equal turns by role and text; null turns come first. Null roles and texts
    are empty. A row without a conv_id is a conversation of its own. Equal conversations share all nodes. Other
    columns aren't read; an empty table gives empty tables. A conversation is read as a whole by one task.
    """
    read = materialise(_read(conversations, files), "turns")
    members = read.where("kind = 0")
    content = read.where("kind = 1")
    # of a node that several tasks put out the first row stays
    light = content.select("node_id", "parent_id", "owner", "depth", "length", "at")
    again = light.groupBy("node_id").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("node_id", "first")
    spare = materialise(light.select("node_id", "at").join(again, "node_id").where("at <> first").select("at"), "spare")
    content, light = (x.join(broadcast_if_small(spare), "at", "left_anti").drop("at") for x in (content, light))
    light = materialise(light, "light")
    owned = light.groupBy("owner").agg(F.min("depth").alias("own_from")).withColumnRenamed("owner", "leaf_id")
    paths = members.select("leaf_id", "path", "lengths").groupBy("leaf_id").agg(F.first("path").alias("path"), F.first("lengths").alias("lengths"))
    paths = materialise(paths.join(owned, "leaf_id", "left"), "paths")

    # subtree sizes: each length is counted by the path that owns it, for its node and all above
    def sums(rows: dict) -> dict:
        out = {"node_id": [], "below": []}
        for path, lengths, own in zip(rows["path"], rows["lengths"], rows["own_from"], strict=True):
            if own is not None:
                below = np.frombuffer(lengths, dtype="<i8")[own:][::-1].cumsum()[::-1]
                out["node_id"] += _split(path)
                out["below"] += [int(below[0])] * own + below.tolist()
        return out

    below = map_slices(paths.select("path", "lengths", "own_from"), lambda: sums, "node_id binary, below bigint", rows=1024).groupBy("node_id").agg(F.sum("below").alias("subtree"))
    kin = written_kin = materialise(light.where("parent_id is not null").select("node_id", "parent_id").join(below, "node_id"), "subtrees")

    # what lies left of a node among its siblings: as many buckets as a bucket has rows, if all were one node's children
    buckets = buckets or max(1, int(kin.count() ** 0.5))
    kin = kin.withColumn("bucket", F.floor(F.conv(F.hex(F.substring("node_id", 1, 4)), 16, 10).cast("bigint") * buckets / (1 << 32)))
    before = Window.partitionBy("parent_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = kin.groupBy("parent_id", "bucket").agg(F.sum("subtree").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    within = Window.partitionBy("parent_id", "bucket").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kin.withColumn("near", F.coalesce(F.sum("subtree").over(within), F.lit(0))).join(left, ["parent_id", "bucket"]).select("node_id", (F.col("near") + F.col("base")).alias("offset"))
    offsets = materialise(offsets.where("offset > 0"), "offsets")  # only children and first ones have none

    def steps(rows: dict) -> dict:
        out = {"leaf_id": [], "depth": [], "node_id": []}
        for leaf, path in zip(rows["leaf_id"], rows["path"], strict=True):
            nodes = _split(path)
            out["leaf_id"] += [leaf] * len(nodes)
            out["depth"] += range(len(nodes))
            out["node_id"] += nodes
        return out

    walked = map_slices(paths.where("own_from is not null").select("leaf_id", "path"), lambda: steps, "leaf_id binary, depth int, node_id binary", rows=1024)
    shifted = walked.join(broadcast_if_small(offsets), "node_id").groupBy("leaf_id").agg(F.collect_list(F.struct("depth", "offset")).alias("shifts"))
    placing = paths.where("own_from is not null").join(shifted, "leaf_id", "left")

    def places(rows: dict) -> dict:
        out = {k: [] for k in ("node_id", "tree_id", "start", "position", "ancestors")}
        for path, lengths, own, shifts in zip(rows["path"], rows["lengths"], rows["own_from"], rows["shifts"], strict=True):
            nodes, shift = _split(path), {x["depth"]: x["offset"] for x in shifts or ()}
            at, position, above = 0, 0, []
            for depth, (node, length) in enumerate(zip(nodes, np.frombuffer(lengths, dtype="<i8").tolist(), strict=True)):
                at += shift.get(depth, 0)
                if depth >= own:
                    for k, v in zip(out, (node, nodes[0], at, position, [{"from": a, "to": b} for a, b in above]), strict=True):
                        out[k].append(v)
                end = at + length
                if above and above[-1][1] == at:
                    above[-1] = (above[-1][0], end)
                else:
                    above.append((at, end))
                at, position = end, position + length
        return out

    schema = "node_id binary, tree_id binary, start bigint, position bigint, ancestors array<struct<from:bigint,to:bigint>>"
    at = materialise(map_slices(placing.select("path", "lengths", "own_from", "shifts"), lambda: places, schema), "places")
    discard(written_kin, offsets, paths, light)
    order = ["tree_id", "node_id", "parent_id", "owner", "depth", "role", "segment", "ids", "length", "start", "position", "ancestors", "loss_from", "loss_to", "loss_from_char", "loss_to_char"]

    def open_paths(rows: dict) -> dict:
        return {"conv_id": rows["conv_id"], "n_turns": rows["n_turns"], "leaf_id": rows["leaf_id"], "tree_id": [p[:16] for p in rows["path"]], "path": [_split(p) for p in rows["path"]]}

    members = map_slices(members.select("conv_id", "n_turns", "leaf_id", "path"), lambda: open_paths, "conv_id bigint, n_turns bigint, leaf_id binary, tree_id binary, path array<binary>", rows=1024)
    return content.join(broadcast_if_small(at), "node_id").select(*order), members


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """leaf_id, formatted (the whole formatted conversation) and loss (its spans that are trained on), from prefix_trees'
    output: a row for each different conversation, which members name by leaf_id.

    A node's text goes straight to the path that owns it; only what other paths share is joined to them.
    """
    parts = nodes.select(F.col("owner").alias("leaf_id"), "node_id", "depth", "segment", "loss_from_char", "loss_to_char")
    steps = members.groupBy("leaf_id").agg(F.first("path").alias("path")).select("leaf_id", F.posexplode("path").alias("depth", "node_id"))
    borrowed = materialise(steps.join(nodes.select(F.col("owner").alias("leaf_id"), "node_id", F.lit(1).alias("own")), ["leaf_id", "node_id"], "left").where("own is null").select("leaf_id", "node_id"), "borrowed")
    lent = materialise(parts.drop("leaf_id").join(broadcast_if_small(materialise(borrowed.select("node_id").distinct(), "lent-ids")), "node_id", "left_semi"), "lent")
    parts = parts.drop("node_id").unionByName(borrowed.join(broadcast_if_small(lent), "node_id").drop("node_id"))
    whole = parts.groupBy("leaf_id").agg(F.sort_array(F.collect_list(F.struct("depth", "segment", "loss_from_char", "loss_to_char"))).alias("parts"))

    def join(rows: dict) -> dict:
        out = {"leaf_id": rows["leaf_id"], "formatted": [], "loss": []}
        for parts in rows["parts"]:
            at, spans = 0, []
            for p in parts:
                if p["loss_to_char"]:
                    spans.append({"from": at + p["loss_from_char"], "to": at + p["loss_to_char"]})
                at += len(p["segment"])
            out["formatted"].append("".join(p["segment"] for p in parts))
            out["loss"].append(spans)
        return out

    return map_slices(whole, lambda: join, "leaf_id binary, formatted string, loss array<struct<from:bigint,to:bigint>>", rows=64)


def digests(formatted: DataFrame) -> DataFrame:
    """leaf_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of read_back's rows."""

    def start():
        def f(rows: dict) -> dict:
            out = {"leaf_id": rows["leaf_id"], "n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for formatted, spans in zip(rows["formatted"], rows["loss"], strict=True):
                turns = parse(formatted)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(formatted[s["from"] : s["to"]]) for s in spans)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, loss)]
                for k, v in zip(list(out)[1:], (len(turns), sha[0], len(loss), sha[1], len(formatted)), strict=True):
                    out[k].append(v)
            return out

        return f

    schema = "leaf_id binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_slices(formatted.select("leaf_id", "formatted", "loss"), start, schema, rows=64)


#: A conversation whose texts are made of the template's control strings.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_prefix_tree_chat(spark, sf_dir: str) -> DataFrame:
    from .packing import tokenizer_files

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PLANTED, "conv_id bigint, turn bigint, role string, text string"))
    nodes, members = prefix_trees(rows, tokenizer_files())
    read = digests(read_back(nodes, members))
    return members.select("conv_id", "leaf_id").join(read, "leaf_id").drop("leaf_id")


#: The same digests straight from the table; lengths of escaped texts by counting what escaping lengthens by one.
ORACLE_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', NULL),
sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS body,
        CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
            ELSE 16 + length(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\n')) END AS marks
    FROM rows)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + SUM(body + marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""
