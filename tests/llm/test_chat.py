import hashlib
import random

import pytest

from tidewright.llm import chat

NASTY = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\l<s>", "<<SYS>>x<</SYS>>", "a\nb", "[[INST]", "<</s>", " [/INST]", "é\U0001f600"]


def test_escape_is_reversible_and_leaves_no_control():
    for t in NASTY:
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_parse_undoes_format():
    turns = [(r, t) for r in ("system", "user", "assistant", "", "odd\nrole[INST]") for t in NASTY]
    assert chat.parse("<s>" + "".join("".join(chat.format_turn(r, t)) for r, t in turns)) == turns
    with pytest.raises(ValueError):
        chat.parse("no begin")


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, segment string, path string")


def read(nodes, members):
    return members.select("conv_id", "leaf_id").join(chat.digests(chat.read_back(nodes, members)), "leaf_id").collect()


def check_places(got):
    """Nodes lie one behind the other, behind their parents, and see just their ancestors."""
    by, trees = {bytes(r.node_id): r for r in got}, {}
    assert len(by) == len(got)
    for r in got:
        trees.setdefault(bytes(r.tree_id), []).append(r)
    for tree in trees.values():
        at, open_ = 0, []
        for r in sorted(tree, key=lambda r: r.start):
            assert r.start == at
            at += r.length
            while open_ and open_[-1] != r.parent_id:
                open_.pop()
            assert bool(open_) == (r.parent_id is not None)  # depth-first: the parent is still open
            open_.append(r.node_id)
            above, p = [], r
            while p.parent_id:
                p = by[bytes(p.parent_id)]
                above.append((p.start, p.start + p.length))
            assert r.depth == len(above) and r.position == sum(b - a for a, b in above) == sum(i["to"] - i["from"] for i in r.ancestors)
            assert all(any(i["from"] <= a and b <= i["to"] for i in r.ancestors) for a, b in above)


def test_many_tasks_and_short_memory(spark, monkeypatch):
    """Nodes that several tasks put out, or one task twice, are there once; conversations are what they were."""
    rng = random.Random(6)
    data = []
    for i in range(400):
        for t in range(rng.randint(1, 7)):
            data.append((i, t, ("user", "assistant")[t % 2], f"turn {rng.choice('ab') if t else 'first'}", None, None))
    df = rows(spark, data)
    monkeypatch.setattr(chat, "SEEN", 3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes, members = chat.prefix_trees(df, buckets=3)
        got = nodes.collect()
        check_places(got)
        want = {}
        for i, _, role, text, _, _ in data:
            want.setdefault(i, []).append((role, text))
        assert {tuple(v[: k + 1]) for v in want.values() for k in range(len(v))} == {tuple(walk(got, r)) for r in got}
        out = {r.conv_id: r for r in read(nodes, members)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(out) == len(want)
    for i, turns in want.items():
        assert out[i].n_turns == len(turns) and out[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def walk(got, r):
    by = {bytes(x.node_id): x for x in got}
    out = []
    while True:
        out.append(r)
        if r.parent_id is None:
            return chat.parse("".join(x.segment for x in reversed(out)))
        r = by[bytes(r.parent_id)]


def test_trees_share_turns_and_read_back(spark):
    data = [
        (1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", "yes", "x", "y"), (2, 0, "user", "hi", "x", "y"), (2, 1, "assistant", "no", "x", "y"), (2, 2, "user", "why", "x", "y"),
        (3, 0, "user", "hi", "x", "y"), (3, 1, "assistant", "yes", "x", "y"), (4, None, None, None, None, None), (None, 0, "user", "anonymous", None, None), (None, 1, "user", "anonymous too", None, None), (5, 1, "b", "2", None, None), (5, 1, "a", "1", None, None), (5, 1, "a", "1", None, None),
    ]
    nodes, members = chat.prefix_trees(rows(spark, data))
    got = nodes.collect()
    assert sum(r.segment.startswith("<s>[INST] hi") for r in got) == 1
    check_places(got)
    out = {r.conv_id: r for r in read(nodes, members)}
    assert len(out) == 6 and out[5].n_turns == 3
    assert out[1].loss_sha256 == hashlib.sha256(b"yes").hexdigest() and out[1].loss_chars == 3
    assert out[2].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nno\nuser\nwhy\n").hexdigest()
    assert sorted(r.n_turns for r in read(nodes, members) if r.conv_id is None) == [1, 1]
    assert out[4].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_tokens_and_empty_table(spark):
    from tidewright.llm.packing import tokenizer_files

    nodes, members = chat.prefix_trees(rows(spark, [(1, 0, "user", "hello", None, None), (1, 1, "assistant", "there", None, None)]), tokenizer_files())
    for r in nodes.collect():
        assert len(r.ids) == 4 * r.length and (r.loss_to > r.loss_from) == (r.role == "assistant")
    nodes, members = chat.prefix_trees(rows(spark, []))
    assert nodes.count() == 0 and members.count() == 0


def test_many_siblings(spark):
    nodes, _ = chat.prefix_trees(rows(spark, [(i, t, "user", f"{'root' if t == 0 else i}", None, None) for i in range(300) for t in (0, 1)]), buckets=15)
    got = sorted(nodes.collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.length
    assert len(got) == 301
