"""The prefix trie against plain lists: shared heads, copies, ties, nulls, conversations and lists of ends over several pieces."""

import hashlib
import random
import re
import zlib

import pytest

from stockyard.llm import trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, weight int, `k1` double, `a.b` int"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(head, [])[:h] + own[c][h:])
    members, ends = {}, {}
    for c, ts in built.items():
        ends.setdefault(ts, []).append(c)
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for node, cs in members.items():
        sub = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in sub if n)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids(node), sum(kids(n) == 0 for n in sub), saved, sha))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 0.5, 2) for r in rows], SCHEMA).repartition(3)
    got = T.trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in got.collect()]


def told(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, monkeypatch):
    """Two turns' texts only, so that prefixes meet; pieces of two turns and blocks of three ids, so that nearly all is carried."""
    monkeypatch.setattr(T, "PIECE", 2)
    monkeypatch.setattr(T, "BLOCK", 3)
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        c = rng.choice([rng.randrange(-30, 60), rng.randrange(100, 140), 2**40 + rng.randrange(40)])
        rows += [(c, rng.choice([None, k, k, 1]), rng.choice(["user", "user", None, ""]), rng.choice(["a b", "a b", "c\td", "é x  y", None, ""])) for k in range(rng.randrange(1, 6))]
    rows += [(None, 1, "user", "lost")] * 3
    assert told(run(spark, rows)) == told(plain(rows))


def test_copies_and_a_long_conversation(spark):
    """A third of the rows are one conversation; half of the others are copies of one."""
    rows = [(100, k, "user", f"turn {k // 2}") for k in range(150)]
    rows += [(c, k, "user" if k % 2 else "assistant", f"same {k}" if c % 2 else f"own {c} {k}") for c in range(200, 275) for k in range(2)]
    assert told(run(spark, rows)) == told(plain(rows))


def test_without_turns_left(spark):
    """Conversations whose own turns are all replaced by those of one that isn't there end at the root."""
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    some = [c for c in h if h[c] >= 2][:3]
    rows = [(c, 1, "user", "x") for c in some]
    assert told(run(spark, rows)) == [(some[0], 0, None, len(some), 0, 1, 0, hashlib.sha256(",".join(map(str, some)).encode()).hexdigest())] == plain(rows)
    more = [*rows, (60, 1, "user", "x y")]
    assert told(run(spark, more)) == told(plain(more))


def test_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []


def test_roles_and_texts_are_kept_apart(spark):
    rows = [(20, 0, "ab", "c"), (40, 0, "a", "bc"), (60, 0, "1:a", "bc"), (80, 0, "", "abc")]
    assert told(run(spark, rows)) == told(plain(rows)) and plain(rows)[0][4] == 4
