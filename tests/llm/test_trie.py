import hashlib
import random
import zlib

from seqspark.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, path string, key string, parent bigint"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "k", 2) for r in rows], SCHEMA).repartition(3)


def table_rows(seed=1):
    """Shared openings, copies, nulls, ties, repeated rows, one conversation alone and one long pair."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), 10**12, 10**12 + 3, -7, -5]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "user", None]), rng.choice(["a", "é b", "", None])))
    rows += [(None, 0, "user", "lost"), (41, 0, "user", "x"), (41, 0, "user", "x"), (42, 0, "user", "w " * 50_000)]
    rows += [(c, t, "user", f"same {t}") for c in (50, 55) for t in range(40)]
    return rows + [(60, t, "user", f"alone {t}") for t in range(300)]


def brute(convs):
    """Nodes of ``{conv_id: [(role, text)]}`` by the definition."""
    members = {}
    for c, w in convs.items():
        for d in range(len(w) + 1):
            members.setdefault(tuple(w[:d]), []).append(c)
    out = set()
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    below = {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        of = [below[x] for x in kids.get(k, [])]
        below[k] = (sum(x[0] for x in of) or 1, own + sum(x[1] for x in of))
        done = ",".join(str(c) for c in sorted(members[k]) if len(convs[c]) == len(k))
        out.add((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(of), *below[k], hashlib.sha256(done.encode()).hexdigest()))
    return out


def turns_of(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            convs.setdefault(c, []).append((t is not None, t or 0, r, tie, x))
    return {c: [(r, x) for _, _, r, _, x in sorted(w)] for c, w in convs.items()}


def nodes(df):
    return [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def test_trie_equals_brute_force(spark):
    rows = table_rows()
    got = nodes(trie.prefix_trie(trie.ordered_turns(frame(spark, rows))))
    assert len(got) == len(set(got)) and set(got) == brute(turns_of(rows))


def test_rebuilt_trie_equals_brute_force(spark):
    rows = table_rows(2)
    convs, out = turns_of(rows), {}
    for c, w in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + w[h:]
    got = nodes(trie.prefix_trie(trie.rebuilt(trie.ordered_turns(frame(spark, rows)))))
    assert len(got) == len(set(got)) and set(got) == brute(out)


def test_conversations_without_turns_and_no_conversations(spark):
    kind = "conv_id bigint, turns array<struct<digest: binary, bytes: bigint>>"
    got = nodes(trie.prefix_trie(spark.createDataFrame([(3, []), (1, [])], kind)))
    assert got == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]
    assert nodes(trie.prefix_trie(spark.createDataFrame([], kind))) == []
    assert nodes(trie.prefix_trie(trie.ordered_turns(frame(spark, table_rows()).limit(0)))) == []


def test_ends_of_ids_far_apart(spark):
    ids = [5, 70_000, 3 << 40, -2, 65_536, 65_535]
    rows = [(c, 0, "user", "hi") for c in ids]
    got = nodes(trie.prefix_trie(trie.ordered_turns(frame(spark, rows))))
    assert set(got) == brute(turns_of(rows))
