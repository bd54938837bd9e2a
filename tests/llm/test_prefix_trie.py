import hashlib
import zlib
from collections import defaultdict

from tallyfield.llm import prefix_trie
from tallyfield.llm.queries import QUERIES


def plain(rows):
    """The whole trie in dictionaries."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], digest(t)))] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + -c % 5
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((
            min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def digest(turn):
    role, text = turn[2:]
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, shard long, key string")


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ordered(QUERIES["op13_prefix_trie"](spark, sf).collect()) == ordered(plain(rows))


def family(convs, lengths):
    """Conversations that share openings of many lengths."""
    return [
        (c, t, "user" if t % 2 else "system", f"turn {t} of kind {(c * 7 + k) % (2 + t)}" if t < n else "x")
        for k, (c, n) in enumerate(zip(convs, lengths, strict=True))
        for t in range(n)
    ]


def test_shards_and_segments_change_nothing(spark, split_groups):
    rows = family(range(60), [(k * 5) % 17 for k in range(60)]) + [(c, t, "u", f"same {t}") for c in (70, 75, 80, 81, 85) for t in range(40)]
    rows += [(90, t, "u", f"same {t}" if t < 37 else f"other {t}") for t in range(50)]
    want = ordered(plain(rows))
    table = frame(spark, rows)
    for turns, segment in ((10_000, 1_024), (30, 1_024), (25, 4)):
        assert ordered(prefix_trie.prefix_trie(table, turns, segment).collect()) == want


def test_odd_rows(spark):
    long = "é\U0001f600" * 50_000
    rows = [
        (1, 0, None, None), (1, 0, "", ""), (2, None, "u", "first"), (2, 5, "u", "b"), (2, 5, "u", "b"), (2, 5, "u", "a"), (-3, 0, "u", "neg"),
        (-5, 1, "u", "neg base"), (-5, 0, "u", long), (-6, 3, "u", "neg"), (None, 0, "u", "lost"), (9223372036854775807, 0, "u", "far"),
        (-9223372036854775808, 0, "u", "far"), (10, 0, "1:a", "b"), (11, 0, "1", "ab"), (12, 0, "u", None), (12, 1, "u", long),
    ]
    rows += [(c, t, "u", f"t{t}") for c in (20, 21, 22, 23, 24) for t in range(12)]
    assert ordered(prefix_trie.prefix_trie(frame(spark, rows)).collect()) == ordered(plain(rows))


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(frame(spark, [(1, 0, "u", "x")]).limit(0)).collect() == []
    assert prefix_trie.prefix_trie(frame(spark, [(None, 0, "u", "x")])).collect() == []


def test_turn_values_are_the_same_on_both_sides(spark):
    row = spark.createDataFrame([(3, b"\x01\xff")], "position long, digest binary").select(*prefix_trie._turn_value()).first()
    assert (row.v0 << 96) + (row.v1 << 64) + (row.v2 << 32) + row.v3 == prefix_trie.turn_value(3, b"\x01\xff")
