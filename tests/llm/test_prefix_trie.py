"""The trie against brute force: awkward rows, long conversations, every size of component."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from stagecast.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, part string, k1 string, depth string, words string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    turns = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest())
            turns.setdefault(conv, []).append((key, (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, sequence in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + sequence[h:]
    nodes, children = {}, {}
    for c, sequence in rebuilt.items():
        for d in range(len(sequence) + 1):
            nodes.setdefault(tuple(sequence[:d]), []).append(c)
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(nodes, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        tokens = len(WORDS.findall(node[-1][1])) if node else 0
        saved[node] = (len(nodes[node]) - 1) * tokens + sum(saved[b] for b in below)
        ends = sorted(c for c in nodes[node] if len(rebuilt[c]) == len(node))
        out.append((
            min(nodes[node]), len(node), min(nodes[node[:-1]]) if node else None, len(nodes[node]), len(below), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


def trie(spark, rows, task_weight):
    frame = spark.createDataFrame([(*r, "clash", "clash", "clash", None) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, prefix_trie.prefix_trie(frame, task_weight).collect()), key=lambda r: r[:2])


def awkward():
    rnd, rows = random.Random(3), []
    for c in [None, *rnd.sample(range(-30, 900), 90)]:
        for t in range(rnd.choice([1, 2, 3, 5, 9, 30])):
            turn = rnd.choice([None, t, t, t])
            text = rnd.choice([None, "", f"a x{t}", f"a x{t}", f"a x{t}", f"y {t % 3}\tz"])
            rows.append((c, turn, rnd.choice(["u", "u", "u", None, ""]), text))
    rows += [(1000 + k, t, "u", f"same {t}") for k in range(60) for t in range(6)]           # copies and their prefixes
    rows += [(1100 + k, t, "u", f"same {t}") for k in range(40) for t in range(k + 1)]       # a chain with a branch per step
    rows += [(7, t, "u", f"long {t}") for t in range(700)]
    return rows + rows[:40]


@pytest.mark.parametrize("task_weight", [20_000, 4])
def test_every_node_and_total(spark, task_weight):
    """With 4 conversations a task most of the tree is split by rounds of joins."""
    rows = awkward()
    got = trie(spark, rows, task_weight)
    assert got == brute(rows)


def test_one_turn_and_no_conversation(spark):
    assert trie(spark, [(5, None, None, None)], 10) == brute([(5, None, None, None)])
    assert trie(spark, [(None, 1, "u", "x")], 10) == []


def test_centroids_of_any_tree():
    rnd = random.Random(1)
    for n in (1, 2, 3, 10, 300):
        for shape in (lambda u: rnd.randrange(u), lambda u: u - 1, lambda u: 0, lambda u: max(0, u - rnd.randint(1, 3))):
            parent = np.array([-1, *(shape(u) for u in range(1, n))])
            values = np.array([[rnd.randint(-5, 9), u] for u in range(n)])
            want = values.copy()
            for u in range(n - 1, 0, -1):
                want[parent[u]] += want[u]
            assert (prefix_trie.finish(parent, values) == want).all()


def test_the_query_reads_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.op11_prefix_trie(spark, folder).collect()), key=lambda r: r[:2])
    assert got == brute(rows)
