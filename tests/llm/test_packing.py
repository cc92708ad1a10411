import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewright.llm import packing


def test_plan_fills_slots_without_overlap():
    rng = random.Random(5)
    for _ in range(20):
        counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
        runs, made = packing.plan_slots(counts, 50)
        taken = {}
        for length, rs in runs.items():
            assert sum(r[1] for r in rs) == counts[length] and [r[0] for r in rs] == [sum(x[1] for x in rs[:i]) for i in range(len(rs))]
            for _, items, first, each, at in rs:
                for i in range(items):
                    taken.setdefault(first + i // each, []).append((at + i % each * length, length))
        assert set(taken) == set(range(made))
        for slots in taken.values():
            end = 0
            for a, n in sorted(slots):
                assert a == end
                end += n
            assert end <= 50
        free = []  # best-fit decreasing, one item at a time
        for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            fit = min((r for r in free if r >= length), default=None)
            if fit is None:
                free.append(50 - length)
            else:
                free[free.index(fit)] = fit - length
        assert made == len(free)


def check(spark, texts, capacity=1024):
    df = spark.createDataFrame(texts, "doc_id bigint, text string, offset string")
    out = packing.pack(packing.materialise(packing.pieces(df, packing.tokenizer_files(), capacity), "t"), capacity, buckets=17).collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for a, n in sorted(s):
            assert a == end
            end += n
        assert end <= capacity
    return out


def test_documents(spark):
    texts = [(1, "word " * 3000, "x"), (2, None, "x"), (3, "", None), (4, "short text", "x"), (4, "short text", "x"), (None, "no id", "x")] + [(10 + i, "a b c " * (i % 7), "x") for i in range(60)]
    out = check(spark, texts)
    t = Tokenizer.from_file(packing.tokenizer_files()[0])
    ids = np.array(t.encode("word " * 3000, add_special_tokens=False).ids + [2], dtype="<u4")
    own = sorted((r for r in out if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.length for r in own][1:] == [1024] * (len(own) - 1) and sum(r.length for r in own) == len(ids) and own[0].length == len(ids) % 1024
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert [r.length for r in out if r.doc_id in (2, 3)] == [1, 1] and sum(r.doc_id == 4 for r in out) == 2 and sum(r.doc_id is None for r in out) == 1


def test_exact_multiples_and_empty(spark):
    assert check(spark, []) == []
    out = check(spark, [(1, "a" * 0, None)], capacity=1)
    assert [(r.piece, r.length) for r in out] == [(0, 1)]
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000)], "doc_id bigint, length bigint"))


def test_strings_of_added_tokens(spark):
    files = packing.tokenizer_files()
    t = Tokenizer.from_file(files[0])
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "no token", "word <|endoftext|> " * 9000]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), files, 1 << 20).collect()
    for r in got:
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert {r.doc_id: r.length for r in got}[0] == 5
