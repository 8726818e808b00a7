import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cosecha.llm import prefix_trie
from cosecha.llm.queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, r, x[:64], hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    original = {c: [(k[2], k[5]) for k in sorted(v)] for c, v in turns.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(original):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(original.get(c - c % 100, [])[:h] + original[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = (not kids[node]) + sum(leaves[k] for k in kids[node])
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in kids[node])
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        ((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(ends[n])) for n, m in members.items()), key=str
    )


def rows():
    out = [(c, t, "user" if t % 2 else "bot", f"text {t} é") for c in range(3, 330, 3) for t in range(c % 7)]
    out += [(c, t, "user", "hello") for c in range(400, 500) for t in range(9)]
    out += [(700, None, None, None), (700, None, "a", "x"), (700, 1, "a", None), (701, 5, "a", "x"), (701, 5, "a", "x"), (701, 5, "a", "w")]
    out += [(None, 1, "user", "nobody's"), (-7, 0, "user", "hello"), (900, 0, "ab", "c"), (901, 0, "a", "bc"), (902, 0, "user", "y" * 200_000)]
    return out


def found(spark, data):
    frame = spark.createDataFrame(data, SCHEMA).repartition(5).withColumn("slice", F.lit("clash")).withColumn("depth", F.lit(1)).withColumn("share", F.lit(None))
    got = prefix_trie.digest(frame)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_equals_brute_force_and_sql(spark):
    assert found(spark, rows()) == brute(rows())
    connection = duckdb.connect()
    connection.execute(f"CREATE TABLE conversations ({SCHEMA.replace('long', 'BIGINT').replace('string', 'VARCHAR')})")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows() if len(r[3] or "") < 1000])
    short = [r for r in rows() if len(r[3] or "") < 1000]
    wanted = connection.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_conversation_trie']})").fetchall()
    assert sorted(wanted, key=str) == brute(short)


@pytest.mark.parametrize("slice_turns", [2, 7])
def test_slices_runs_and_heavy_parents_change_nothing(spark, monkeypatch, slice_turns):
    monkeypatch.setattr(prefix_trie, "SLICE", slice_turns)
    monkeypatch.setattr(prefix_trie, "MANY", 1)
    monkeypatch.setattr(prefix_trie, "HEAVY", 10)
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 8)
    data = rows() + [(200, t // 2, "user", f"long {t // 5}") for t in range(60)]
    assert found(spark, data) == brute(data)


def test_a_conversation_of_a_third_of_all_rows_and_repeated_rows(spark):
    data = [(1000, t, "user", f"t{t}") for t in range(1500)] + [(1001, 0, "user", "again")] * 1400 + [(c, 0, "user", "t0") for c in range(2000, 3500)]
    assert found(spark, data) == brute(data)


def test_no_conversations_no_nodes(spark):
    assert prefix_trie.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.digest(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
