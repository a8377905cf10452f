"""The conversation trie against nodes made one by one."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from courtside.llm import prefix_trie, queries

from ..conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, n string, head1 long, path string"


def _nodes(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(r)] for c, r in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append(c)
        ends[tuple(rebuilt)].append(c)
    children, total = defaultdict(list), {}
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        total[node] = (sum(total[k][0] for k in children[node]) if children[node] else 1, saved + sum(total[k][1] for k in children[node]))
    return sorted(
        (members[x][0], len(x), members[x[:-1]][0] if x else -1, len(members[x]), len(children[x]), *total[x], hashlib.sha256(",".join(map(str, ends.get(x, []))).encode()).hexdigest()) for x in members)


def _got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def _hard(rng):
    texts = ["a b", "a b", "a  b c", "", None, "x"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "", None]), rng.choice(texts)) for c in [*range(80), None] for _ in range(rng.randint(0, 7))]
    rows += [(c, t, "user", f"w {t}") for c in (200, 201, 240, 260) for t in range(23 + c % 3)]  # long, with one beginning
    return rows + rows[:10] + [(300 + c, 0, "user", "hot") for c in range(60)] + [(300 + c, 1, "user", f"then {c % 7}") for c in range(60)]


@pytest.mark.parametrize("segment, limit", [(1024, 4096), (1024, 1), (1024, 5), (4, 3), (1, 1), (7, 1000)])
def test_nodes_equal_definition(spark, segment, limit):
    rows = _hard(random.Random(segment))
    docs = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA)
    assert _got(prefix_trie.trie(*prefix_trie.rebuilt(docs), segment, limit)) == _nodes(rows)


def test_query_equals_definition(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert _got(queries.op11_prefix_trie(spark, SMALL)) == _nodes([tuple(r) for r in rows])


def test_empty_and_turnless(spark):
    of = lambda rows: _got(prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert of([]) == [] and of([(None, 1, "user", "x")]) == []
    lone = [(1, 0, "user", "gone")]  # crc32("1") % 4 = 3 and there is no conversation 0
    assert of(lone) == _nodes(lone) and len(of(lone)) == 1
