"""Conversation trie against a plain count over all beginnings."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from innlytics.llm import conversation_trie as CT

SCHEMA = "conv_id long, turn long, role string, text string, codes int, shard string"


def plain(rows):
    """{(conv_id, depth): (parent, members, children, leaves, saved, ends)} of the contract's trie."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[:d - 1]].add(s[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0
        saved[p] = own_saved + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                               hashlib.sha256(",".join(map(str, sorted(c for c in m if seqs[c] == p))).encode()).hexdigest())
            for p, m in members.items()}


def check(spark, rows, turns=CT.SHARD_TURNS):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = CT.conversation_trie(df, turns).collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
           for r in out}
    assert len(got) == len(out)
    assert got == plain(rows)


@pytest.fixture()
def talk():
    """Conversations over few turns, so that beginnings are shared, with hot and long ones."""
    r = random.Random(5)
    rows = []
    for c in range(150):
        if c % 20 or c % 3 == 0:
            for turn in range(r.randint(1, 6)):
                rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["a", "b c", "b c d", ""])))
    for c in range(200, 260):
        rows += [(c, t, "user", "hello there") for t in range(4)]
    for c in (300, 301, 302):
        rows += [(c, t, "user", f"word {t}") for t in range(120)]
    return rows


def test_every_node_equals_a_plain_count(spark, talk):
    check(spark, talk)


@pytest.mark.parametrize("turns", [1, 7, 60])
def test_boundary_nodes_over_many_shards(spark, talk, turns):
    check(spark, talk, turns)


def test_nulls_ties_repeated_rows_and_turnless(spark):
    check(spark, [(None, 0, "user", "left out"), (5, None, "user", "first"), (5, 0, None, None), (5, 0, None, "tie"),
                  (5, 0, None, "tie"), (25, 3, "user", "own is cut"), (1, 0, "", ""), (2, 0, None, None),
                  (-7, 1, "user", "x"), (10 ** 12 + 3, 0, "u", "é ﬁ\x00 z")])


def test_all_equal_and_empty(spark):
    check(spark, [(c, t, "user", "same") for c in range(0, 9000, 100) for t in range(3)], 1)
    assert CT.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(None, 0, "user", "nobody's")])


def test_ids_of_equal_conversations_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(CT, "BLOCK_IDS", 10)
    check(spark, [(c, 0, "user", "same") for c in range(0, 95)])


def test_search_tree_is_balanced_and_in_order():
    seqs = sorted([a, b] for a in range(200) for b in range(3)) + [[500] + list(range(2000))]
    tree = CT.SearchTree(seqs)
    order = tree.walk()
    assert len(order) == len(tree.code) == 200 * 4 + 2001
    def height(k):
        return 0 if k < 0 else 1 + max(height(tree.low[k]), height(tree.high[k]))
    assert height(tree.root) <= 10
    assert all(order.index(tree.up[k]) < i for i, k in enumerate(order[:100]) if tree.up[k] >= 0)
