import hashlib
import random
import zlib

from pyspark.sql import functions as F

from catalogspark.llm import trie as Z

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """conv_id -> its (role, text) in order."""
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv_id, []).append(((turn is not None, turn or 0), tie, (role, text)))
    return {c: [t for *_, t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for prefix, members in nodes.items():
        under = [(p, m) for p, m in nodes.items() if p[:len(prefix)] == prefix]
        kids = lambda x: sum(len(p) == len(x) + 1 and p[:len(x)] == x for p in nodes)
        ends = sorted(c for c in members if len(convs[c]) == len(prefix))
        rows.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), kids(prefix),
                     sum(kids(p) == 0 for p, _ in under), sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in under if p),
                     hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def got(spark, rows, again=True):
    turns = Z.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    if again:
        turns, convs = Z.rebuild(turns)
    else:
        turns, convs = turns.withColumnRenamed("n", "depth"), turns.select("conv_id").distinct()
    return sorted(map(tuple, Z.prefix_trie(turns, convs).collect()), key=lambda r: r[:2])


def test_places_and_running_values_of_keys_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(7 if rng.random() < 0.6 else rng.randrange(12), k, rng.getrandbits(63) - 2**62, rng.randrange(99)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "k long, o long, x long, s long").repartition(5)
    seen = {}
    for r in sorted(Z.along(frame, "k", ["o"], ("x",), ("s",)).collect(), key=lambda r: (r.k, r.o)):
        n, x, s = seen.get(r.k, (0, 0, 0))
        seen[r.k] = n, x, s = n + 1, x ^ r.x, s + r.s
        assert (r.n, r.x_upto, r.s_upto) == (n, x, s)
    assert sum(n for n, *_ in seen.values()) == 3000


def test_fattest_numbers(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", Z.fattest("a", "b").alias("f")).collect()
    for a, b, f in rows:
        assert f == max(range(a + 1, b + 1), key=lambda n: n & -n)


def test_equals_all_prefixes_of_branching_conversations(spark):
    rng, rows = random.Random(11), []
    for c in range(70):
        turns = ["greet"] * (c % 3 > 0) + [rng.choice("ab") * (1 + d % 3) for d in range(rng.randrange(12))]
        rows += [(c, d, "user" if d % 2 else "assistant", t) for d, t in enumerate(turns)]
    # Copies, one that is the start of another, a long one with branches in its middle, and a caterpillar.
    rows += [(200 + c, d, "user", f"é{d}") for c in range(9) for d in range(4)]
    rows += [(300, d, "user", f"é{d}") for d in range(2)]
    long = [("user", f"turn {d}") for d in range(150)]
    for k in range(14):
        rows += [(400 + k, d, role, text) for d, (role, text) in enumerate(long[:11 * k] + [("user", f"own {k}")] * (k % 2))]
    rng.shuffle(rows)
    assert got(spark, rows, False) == brute(ordered(rows))
    assert got(spark, rows) == brute(rebuilt(ordered(rows)))


def test_edge_conversations(spark):
    rows = [(None, 0, "user", "no id"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 2, "user", "Ünï 日本"),
            (2, 5, "a", "tie"), (2, 5, "b", "tie"), (2, 5, "a", "tie "), (-3, 0, "user", "negative"), (-5, 0, "user", "negative"),
            (-5, 1, "user", "more"), (5, 0, "", ""), (6, 0, "", ""), (9, 0, "user", "x" * 100_000)]
    assert got(spark, rows) == brute(rebuilt(ordered(rows)))
    assert got(spark, rows, False) == brute(ordered(rows))
    empty = spark.createDataFrame(rows, SCHEMA).limit(0).withColumn("n", F.lit(1))
    turns, convs = Z.rebuild(Z.numbered_turns(empty))
    assert Z.prefix_trie(turns, convs).count() == 0
    # Conversations without a turn: one node, the root.
    assert [tuple(r)[:7] for r in Z.prefix_trie(turns, spark.range(4, 6).withColumnRenamed("id", "conv_id")).collect()] == [(4, 0, None, 2, 0, 1, 0)]
