"""Best-fit packing planned over a histogram of lengths.

The plan places counts, not documents: a histogram of piece lengths (at most `capacity` numbers) goes to
the driver, best-fit decreasing runs over it there, and gives runs of equal slots for each length. Pieces
then take slots by their rank within their length. Ranks come from counts by (length, bucket) and a
window inside each bucket, so that a length that a third of all pieces share isn't one task's work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_slices, materialise, table

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_files() -> tuple[str, str, str]:
    """Tokenizer file, the same vocabulary as ranks, and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, files: tuple, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32).

    A document is the ids of its whole text and then end_id. One of up to `capacity` tokens is one piece.
    A longer one is cut into full pieces behind a first piece that takes the remainder. A null or empty
    text is the one id end_id. `files` are the arguments of BytePairEncoder: a tokenizer file and, where there
    is one, its rank table and pattern. Null and repeated doc_ids are kept: every row is a document of its own.
    Columns other than doc_id and text are not read.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")
    end = np.uint32(end_id).tobytes()

    def start():
        from .bpe import BytePairEncoder

        encoder = BytePairEncoder(*files)

        def cut(rows: dict) -> dict:
            out: dict[str, list] = {k.split()[0]: [] for k in schema.split(", ")}
            for doc_id, ids in zip(rows["doc_id"], encoder.encode([t or "" for t in rows["text"]]), strict=True):
                ids += end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                at, piece = 0, 0
                while at < n:
                    length = first if piece == 0 else capacity
                    own = ids[4 * at : 4 * (at + length)]
                    row = [doc_id, piece, at, length, zlib.crc32(own)] + ([own] if keep_ids else [])
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                    at, piece = at + length, piece + 1
            return out

        return cut

    return map_slices(docs.select("doc_id", "text"), start, schema)


def plan_slots(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Best-fit decreasing over counts.

    Returns, by length, runs (first rank, items, first sequence, items in each sequence, offset in it), and
    the number of sequences. The items of a run fill its sequences one after the other.
    """
    space: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: (first sequence, sequences)
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    made = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in range(length, capacity + 1):  # the tightest first; what a sequence has left stays the tightest
            each = room // length
            while left and space[room]:
                first, n = space[room].pop()
                n_used = min(n, -(-left // each))
                items = min(left, n_used * each)
                runs.setdefault(length, []).append((rank, items, first, each, capacity - room))
                full, rest = divmod(items, each)
                if full:
                    space[room - each * length].append((first, full))
                if rest:
                    space[room - rest * length].append((first + full, 1))
                if n > n_used:
                    space[room].append((first + n_used, n - n_used))
                left, rank = left - items, rank + items
            if not left:
                break
        if left:
            each = capacity // length
            n = -(-left // each)
            runs.setdefault(length, []).append((rank, left, made, each, 0))
            full, rest = divmod(left, each)
            if full:
                space[capacity - each * length].append((made, full))
            if rest:
                space[capacity - rest * length].append((made + full, 1))
            made += n
    return runs, made


def pack(parts: DataFrame, capacity: int = 1024, buckets: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `capacity` tokens; other columns stay.

    `parts` is read more than once and should be a written table. It needs a column `length`; columns named
    like those that are added (sequence_id, offset) are replaced. Equal rows take slots of their own; an
    empty table gives an empty table; a length that is null, below 1 or above `capacity` raises ValueError. Ranks
    go by `buckets` of each length, by default as many as the root of the number of pieces.
    """
    keep = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    counted = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows, else refused
    counts = {r["length"]: r["n"] for r in counted}
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    runs, _ = plan_slots(counts, capacity)
    buckets = buckets or max(1, int(sum(counts.values()) ** 0.5))  # of the most frequent length: no more buckets than rows in one
    order = [F.col(f"`{c}`") for c in keep if dict(parts.dtypes)[c] in ("bigint", "int", "string", "double")]
    rows = parts.select(*[F.col(f"`{c}`") for c in keep], F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("__bucket"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("length", "__bucket").orderBy(*order)
    ranked = rows.withColumn("__rank", F.row_number().over(within) - 1).join(bases, ["length", "__bucket"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in keep], (F.col("__rank") + F.col("__base")).alias("__rank"))
    starts = {length: [r[0] for r in rs] for length, rs in runs.items()}
    fields = [f for f in parts.schema.fields if f.name in keep]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def start():
        def place(part: dict) -> dict:
            seq, off = [], []
            for length, rank in zip(part["length"], part.pop("__rank"), strict=True):
                first, _, base, each, at = runs[length][bisect_right(starts[length], rank) - 1]
                q, r = divmod(rank - first, each)
                seq.append(base + q)
                off.append(at + r * length)
            return part | {"sequence_id": seq, "offset": off}

        return place

    return map_slices(ranked, start, schema, rows=4096)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(materialise(pieces(docs, tokenizer_files()), "pieces"))
