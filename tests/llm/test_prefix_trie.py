import hashlib
import random
import re
import zlib

from compare import database, of_duckdb, of_spark
from conftest import SF
from lexigrain.llm import queries
from lexigrain.llm.prefix_trie import prefix_trie, shared_heads, turns_of

SCHEMA = "conv_id long, turn long, role string, text string, digest string, place int, node string"


def test_against_sql(spark):
    assert of_spark(queries.op13_prefix_trie(spark, SF)) == of_duckdb(database(SF), queries.oracle_sql()["op13_prefix_trie"])


def nodes_of(convs):
    """The rows for whole conversations, by identifier."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        leaves = sum(1 for n in below if not any(x[: len(n)] == n and len(x) == len(n) + 1 for x in below))
        joined = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids), leaves, saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(c / 20) * 20
        out[c] = own.get(c - base, [])[:h] + turns[h:]
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    said = ["", None, "a b", "a  b\tc", "x\x0by", "é ü", "w " * 3_000]
    rows = []
    for c in [*range(0, 130), -45, -40, 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 9])):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(said), "clash", 1, "clash"))
    rows += rows[:20] + [(None, 0, "user", "nobody", "", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(prefix_trie(*shared_heads(turns_of(df)))) == nodes_of(rebuilt(rows))


def test_long_and_common_conversations(spark):
    """One conversation of most of the turns, many equal ones, and one first turn that all have."""
    rows = [(0, t, "user", f"t{t % 3}", "", 1, "") for t in range(150)]
    rows += [(c, t, "user", f"t{t}", "", 1, "") for c in range(1, 60) for t in range(3)]
    rows += [(c, t, "user", "t0" if t == 0 else f"{c}", "", 1, "") for c in range(60, 120) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    convs = {}
    for c, _, role, text, *_ in rows:
        convs.setdefault(c, []).append((role, text))
    turns = turns_of(df)
    assert rows_of(prefix_trie(turns, turns.select("conv_id").distinct())) == nodes_of(convs)


def test_turnless_conversations_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(*shared_heads(turns_of(empty))).collect() == []
    turns = turns_of(empty)
    convs = spark.createDataFrame([(7,), (5,), (10,)], "conv_id long")
    assert rows_of(prefix_trie(turns, convs)) == nodes_of({5: [], 7: [], 10: []})
    own = turns_of(spark.createDataFrame([(5, 0, "u", "x", "", 1, "")], SCHEMA))
    assert rows_of(prefix_trie(own, convs)) == nodes_of({5: [("u", "x")], 7: [], 10: []})
