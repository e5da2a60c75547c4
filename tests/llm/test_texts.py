"""Quality rules, near-duplicates, decontamination, personal data and token ids against plain versions, on small and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.llm import bytetext as B
from stockyard.llm import decontaminate as D
from stockyard.llm import omh, pieces, pii, quality, tagger

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, bucket int"
R = random.Random(4)
VOCABULARY = ["".join(R.choice("abcdeéilnorstuñ") for _ in range(R.randint(2, 9))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


ODD = [(None, None, None), (None, "x", None), (7, "", "s"), (7, "", "s"), (8, " \n\t ", "s"), (9, "w " * 60_000, "s"), (10, "  a b\nc\r\n\n", "s")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 0 if t is None else len(t), 1) for i, t, s in rows], SCHEMA)


# Bytes


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a bc\tdé", None, "", "a", "  bc ", "dé\x0bdé"]
    (lo, hi, data, at), *_ = B.slices(pa.array(texts))
    s, e, bounds = B.words(data, at)
    got = [[bytes(data[a:b]).decode() for a, b in zip(s[bounds[i] : bounds[i + 1]], e[bounds[i] : bounds[i + 1]])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    h = defaultdict(set)
    for w, x in zip([w for t in got for w in t], B.segments(data, s, e).tolist()):
        h[w].add(x)
    assert all(len(v) == 1 for v in h.values()) and len({next(iter(v)) for v in h.values()}) == len(h)


def test_hashes_of_long_texts(monkeypatch):
    """Blocks change no hash; a text of 20 MB leaves no table behind that grew with it."""
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    e = np.unique(r.integers(1, 5001, 700))
    s = np.maximum(0, e - 3)
    whole = B.segments(data, s, e)
    same = B.segments(np.concatenate([data[:7], data]), s + 7, e + 7)
    assert (whole == same).all()
    monkeypatch.setattr(B, "BLOCK", 64)
    B.powers.cache_clear()
    assert (B.segments(data, s, e) == whole).all()
    monkeypatch.undo()
    B.powers.cache_clear()
    long = np.resize(data, 20 << 20)
    B.segments(long, np.array([0, len(long) - 9]), np.array([len(long) // 2, len(long)]))
    assert sum(a.nbytes for b in (B.BYTE_BASE, B.WORD_BASE) for a in B.powers(b)) == 4 * 8 * B.BLOCK <= 4 << 20


# Quality


def plain_measures(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {p + k for p in range(len(w) - 2) if tri[tuple(w[p : p + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    texts = ["a b c a b c d\na b c\n\na b c", "é é é é", "# * <x> |", "x\n x\nx", prose(300, 1), *[t for _, t, _ in ODD]]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    for r in quality.judged(frame(spark, rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(texts[r._id] or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_frequent_lines(spark):
    common = "All  Rights reserved 2019 " + prose(60, 2)
    rows = [(i, prose(55, 100 + i) + "\n" + common.replace("2019", str(2000 + i)).upper().lower(), "h") for i in range(8)]
    rows += [(i, common + "\nshort end here", "h") for i in range(20, 24)] + [(50, common, "other"), (51, None, "h")]
    got = {r._id: r for r in quality.judged(frame(spark, rows), limit=5).collect()}
    n = len(WORD.findall(common))
    assert got[0].n_removed_words == 0 and got[0].kept  # it keeps the line
    assert all(got[i].n_removed_words == n and got[i].kept for i in range(1, 8))
    assert all(got[i].n_removed_words == n and not got[i].kept and not got[i].base_failed for i in range(20, 24))
    assert got[50].n_removed_words == 0 and got[50].kept and not got[51].kept
    left = {r.doc_id: r for r in quality.clean(frame(spark, rows), limit=5).collect()}
    assert set(left) == {*range(8), 50} and left[3].text == prose(55, 103) and left[3].n_chars == len(left[3].text) and left[3].bucket == 1


def test_columns_that_need_quotes(spark):
    docs = frame(spark, [(1, prose(60, 1), "s"), (2, prose(60, 1), "s")]).withColumn("my col", F.lit(1)).withColumn("x-y", F.lit("z"))
    for got in (quality.clean(docs), omh.deduplicated(docs), D.decontaminated(docs, spark.createDataFrame([(1, "a b")], "item_id int, text string")), pii.redact(docs)):
        assert got.columns == docs.columns and got.count() >= 1


def test_columns_that_clash(spark):
    """Dots, spaces, quotes, and the names that operators use inside."""
    names = ["_leaking_text", "_leaking_id", "leaking", "row", "key", "id", "_kept", "a.b", "c`d", "e f", "hash", "c0"]
    docs = frame(spark, [(1, prose(60, 1) + " a@b.com", "s"), (None, None, None)]).withColumns({n: F.lit(k) for k, n in enumerate(names)})
    b = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    for got in (D.decontaminated(docs, b), pii.redact(docs)):
        assert got.columns == docs.columns and [tuple(r)[5:] for r in got.collect()] == [tuple(range(len(names)))] * 2
    dotted = docs.withColumnRenamed("doc_id", "doc.id").withColumnRenamed("text", "my.text")
    for got in (D.decontaminated(dotted, b, id_col="doc.id", text_col="my.text"), pii.redact(dotted, "my.text"), pii.detect(dotted, "doc.id", "my.text"), pieces.encoded(dotted, id_col="doc.id", text_col="my.text")):
        assert got.count() == 2


def test_quality_odd_rows(spark):
    assert len(quality.judged(frame(spark, ODD)).collect()) == len(ODD) and quality.judged(frame(spark, [])).collect() == []


# Near-duplicates


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_alignment(seed):
    r = random.Random(seed)
    a = [r.randrange(12 if seed % 2 else 500) for _ in range(r.randint(1, 120))]
    b = list(a)
    for _ in range(r.randint(0, 12)):
        k = r.randrange(len(b) + 1)
        b[k : k + r.randint(0, 2)] = [r.randrange(500) for _ in range(r.randint(0, 2))]
    want = (x := lcs(a, b)) / max(len(a) + len(b) - x, 1)
    got = omh.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def edited(text, n, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


def test_classes(spark):
    base = [prose(n, 200 + n) for n in (12, 40, 150, 600)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    rows += [(60 + i, t, "s") for i, t in enumerate(base)] + [(60, base[0], "s")]
    rows += [(20 + i, t + " end", "s") for i, t in enumerate(base)]
    rows += [(100 + i, edited(base[3], 6, i), "s") for i in range(40)]
    rows += [(200 + i, edited(base[2], 30, i), "s") for i in range(5)]
    words = base[3].split(" ")
    rows += [(300, " ".join(words[300:] + words[:300]), "s"), *ODD]
    got = defaultdict(set)
    for r in omh.classes(frame(spark, rows)).collect():
        got[r._kept.doc_id].add(r.class_id)
    for i in range(4):
        assert got[i] == got[60 + i] == got[20 + i] == {i}
    assert all(got[100 + i] == {3} for i in range(40))
    assert all(got[200 + i] == {200 + i} for i in range(5))
    assert got[300] == {300}  # the same k-mers in another order
    assert got[7] == got[8] == {7}  # no word: one class, with the null text
    kept = omh.deduplicated(frame(spark, rows)).collect()
    assert len(kept) == len({c for v in got.values() for c in v}) and omh.deduplicated(frame(spark, [])).collect() == []


def family(n, seed, words=700, own=10):
    """n texts in pairs: a template with `own` words of a text's own, in the same places in both of a pair and in other places elsewhere."""
    r, template, out = random.Random(seed), prose(words, seed).split(" "), []
    for i in range(n // 2):
        at = r.sample(range(2, words - 2, 5), own)
        for side in "xy":
            w = list(template)
            for k in at:
                w[k] = f"o{i}{side}{k}"
            out.append(" ".join(w))
    return out


def brute_links(texts):
    """All pairs that align at 0.8; only those whose labelled k-mers overlap enough as sets are aligned."""
    import pyarrow as pa

    each = []
    for _, _, data, at in B.slices(pa.array(texts)):
        h, bounds = omh.kmers(data, at)
        each += [h[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
    sets = [omh.occurrence_labelled(x) for x in each]
    seen, times = np.unique(np.concatenate(sets), return_counts=True)
    seen = seen[times > 1]
    m = np.zeros((len(sets), len(seen)), np.float32)
    for i, x in enumerate(sets):
        m[i, np.searchsorted(seen, x[np.isin(x, seen)])] = 1
    n = np.array([len(x) for x in sets])
    both = m @ m.T
    near = np.argwhere(np.triu(both >= 0.8 * (n[:, None] + n[None] - both) - 1e-3, 1))
    return [(i, j) for i, j in near.tolist() if omh.aligned(each[i], each[j]) >= 0.8]


def test_no_possible_pair_is_left_out(spark):
    texts = family(300, 77)
    links = brute_links(texts)
    assert len(links) >= 150
    rows = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    members = rows.selectExpr("doc_id AS node", "doc_id AS comp")
    rows = rows.selectExpr("doc_id AS _row", "struct(*) AS _kept")
    got = {(r.a, r.b) for r in omh._possible(members, rows, "text", 0.8).collect()}
    assert got >= set(links) and len(got) < 300 * 299 / 2


@pytest.mark.parametrize("seed", [5])
def test_classes_equal_brute_force(spark, seed):
    """The whole operator on two families of one template each and on copies with few to many edits: classes of all pairs at 0.8."""
    r = random.Random(seed)
    texts = family(80, seed, 300, 6) + family(60, seed + 1, 120, 3)
    base = [prose(r.randint(20, 300), 900 + k) for k in range(40)]
    texts += base + [edited(t, r.randint(0, 1 + len(t) // 250), k) for k, t in enumerate(base * 5)]
    node = list(range(len(texts)))

    def top(i):
        while node[i] != i:
            i = node[i]
        return i

    links = brute_links(texts)
    for i, j in links:
        a, b = sorted((top(i), top(j)))
        node[b] = a
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    r.shuffle(rows)
    got = {x._kept.doc_id: x.class_id for x in omh.classes(frame(spark, rows)).collect()}
    assert got == {i: top(i) for i in range(len(texts))} and len(links) > 250 and 60 < len(set(got.values())) < len(texts)


# Decontamination


def test_leaks(spark):
    items = [(1, prose(30, 300)), (2, "A train leaves at 14:30 and travels 250 km in 5 hours, so what is its speed in km per hour then"), (3, "two words"), (4, None), (5, "")]
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    docs = [
        (1, prose(50, 1) + " " + items[0][1] + " " + prose(20, 2), "s"),
        (2, prose(50, 3) + " " + " ".join(items[0][1].split(" ")[:8]) + " " + prose(20, 4), "s"),
        (3, "Well. A TRAIN leaves at 9:15 and travels 480 km in 6 hours, so what is its speed in km per hour then? ".replace("TRAIN", "train") + prose(9, 5), "s"),
        (4, "two words", "s"), (5, "two words more", "s"), (6, prose(200, 6), "s"), (7, items[0][1].upper().lower().replace(" ", "\n"), "s"), *ODD,
    ]
    got = {(r.doc_id, r.item_id): r for r in D.leaks(frame(spark, docs), b).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 3), (7, 1)}
    assert got[1, 1].exact and got[1, 1].covered == 30 and not got[3, 2].exact and got[3, 2].n_slots >= 3
    left = D.decontaminated(frame(spark, docs), b)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d[0]) for d in docs if d[0] not in (1, 3, 4, 7)) and left.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert D.leaks(frame(spark, []), b).collect() == [] and D.leaks(frame(spark, docs), b.limit(0)).collect() == []


def test_inconsistent_slots(spark):
    b = spark.createDataFrame([(1, "x y z 5 a b c 5 d e f g")], "item_id bigint, text string")
    docs = [(1, "x y z 8 a b c 8 d e f g", "s"), (2, "x y z 8 a b c 9 d e f g", "s")]
    assert [r.doc_id for r in D.leaks(frame(spark, docs), b).collect()] == [1]


def test_canonical_tokens_stand_beside_raw_ones(spark):
    texts = ["A b, C d. Paul e 5kg 7 kg! $3.50 -- x) (y 12:30. “q” 50% end", prose(80, 9), "# | ++ a", "...", "Don’t stop Mary’s 3rd", "Well. Mary Ann (Bob Lee), Eve Tom5 Jo Ann! \x01n Al \x03 Bo"]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in df.select("text", D.canonical_tokens(df.text, False).alias("c"), D.raw_tokens(df.text).alias("r"), D.canonical_tokens(df.text).alias("fc"), D.slot_tokens(df.text).alias("fr")).collect():
        assert len(r.c) == len(r.r), (r.c, r.r)
        assert len(r.fc) == len(r.fr), (r.fc, r.fr)


def test_names_and_ids(spark):
    """Names of another number of words, names at sentence starts, words put in, null ids, two names that meet one."""
    item = "Tom has 5 apples. Anna eats 2 of them. Tom buys 4 more. How many are left?"
    long = " ".join(f"w{k}" for k in range(59))
    w = long.split(" ")
    b = spark.createDataFrame([(1, item), (2, long), (None, "a farmer called Tom sold 48 clips to Anna and then half as many clips in May")], "item_id bigint, text string")
    docs = [
        (1, "Well. Mary Ann has 7 apples. Bob eats 3 of them. Mary Ann buys 9 more. How many are left?", "s"),
        (None, "x y z " + item, "s"),
        (3, " ".join([*w[:20], "new", *w[20:40], "other", *w[40:]]), "s"),
        (4, "Eve has 7 apples. Eve eats 3 of them. Eve buys 9 more. How many are left?", "s"),
        (5, "a farmer called Mary Jo sold 12 clips to Bob and then half as many clips in June", "s"),
        (None, "nothing here", "s"), (None, None, "s"),
    ]
    got = {(r.doc_id, r.item_id) for r in D.leaks(frame(spark, docs), b).collect()}
    assert got == {(1, 1), (None, 1), (3, 2), (5, None)}
    left = D.decontaminated(frame(spark, docs), b).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted((str(d[0]), str(d[1])) for d in (docs[3], docs[5], docs[6]))


def plain_leaks(docs, items, window, share):
    """All windows of all pairs of a document and an item, from canonical and slot tokens."""
    out = set()
    for d, (dc, dr) in docs.items():
        for i, (ic, ir) in items.items():
            size, n = min(window, len(ic)), len(ic)
            if len(ic) < window or len(dc) < window:
                if dc == ic and any(t[0] != "\x01" for t in ic):
                    ways = {0: [(0, 0)]}
                else:
                    continue
            else:
                hits = [(p, q - p) for p in range(n - window + 1) for q in range(len(dc) - window + 1) if ic[p : p + window] == dc[q : q + window] and any(t[0] != "\x01" for t in ic[p : p + window])]
                ways = defaultdict(list)
                for p, s in hits:
                    for key in ((0, s), (1, s // D.BAND), (2, (s + D.BAND // 2) // D.BAND)):
                        ways[key].append((p, s))
                chains: list[list[int]] = []
                for s in sorted({s for _, s in hits}):
                    if not chains or s - chains[-1][-1] > D.BAND:
                        chains.append([])
                    chains[-1].append(s)
                for c in chains:
                    mine = [h for h in hits if c[0] <= h[1] <= c[-1]]
                    if c[-1] - c[0] >= D.BAND // 2:
                        for p in {p for p, _ in mine}:
                            near = [s for q, s in mine if abs(q - p) <= D.REACH]
                            ways[3, c[0]].append(min((abs(s - sum(near) / len(near)), s, (p, s)) for q, s in mine if q == p)[2])
            for hs in ways.values():
                if len({p + k for p, _ in hs for k in range(size)}) < -(-share * n // 1):
                    continue
                pairs = {(ic[p + k], ir[p + k].lower(), dr[p + k + s].lower()) for p, s in hs for k in range(size) if ic[p + k][0] == "\x01"}
                names = {x for x in pairs if x[0] == D._NAME}
                if len({x[:2] for x in pairs}) == len(pairs) and len({x[2] for x in names}) == len(names):
                    out.add((d, i))
    return out


def test_words_put_in_along_a_long_item(spark):
    """A whole copy with a word put in (or another left out) after every so many: shifts add up far beyond a band."""
    items, docs = [], []
    for k, (n, gap) in enumerate([(200, 10), (400, 20), (400, 10), (800, 20), (800, 30), (1500, 12), (600, -12)]):
        words = prose(n, 900 + k).split(" ")
        items.append((k, " ".join(words)))
        copy = [x for j, w in enumerate(words) for x in ([w, f"new{j}"] if gap > 0 and j % gap == gap - 1 else [] if gap < 0 and j % -gap == 0 else [w])]
        docs.append((k, prose(100, 950 + k) + " " + " ".join(copy) + " " + prose(60, 970 + k), "s"))
        # The same words in another order, and a third of the item, are none.
        r = random.Random(k)
        docs += [(100 + k, " ".join(r.sample(words, n)), "s"), (200 + k, prose(50, k) + " " + " ".join(words[: n // 3]), "s")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(frame(spark, docs), b).collect()}
    assert set(got) == {(k, k) for k in range(len(items))}
    assert all(r.n_slots == 0 and r.covered >= 0.4 * r.n_item_tokens for r in got.values())


def test_slots_along_a_chain(spark):
    """Numbers all along a long item, words put in between: one value must stand for each."""
    words = prose(300, 77).split(" ")
    item = [x for j, w in enumerate(words) for x in ([w, str(j)] if j % 9 == 0 else [w])]
    b = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    put_in = lambda change: " ".join(x for j, w in enumerate(item) for x in ([change(w, j), f"new{j}"] if j % 11 == 10 else [change(w, j)]))
    docs = [(1, put_in(lambda w, j: str(int(w) + 7) if w.isdigit() else w), "s"), (2, put_in(lambda w, j: w), "s")]
    assert {(r.doc_id, r.exact) for r in D.leaks(frame(spark, docs), b).collect()} == {(1, False), (2, True)}


@pytest.mark.parametrize("seed", range(6))
def test_leaks_equal_brute_force(spark, seed):
    r = random.Random(seed)
    some = ["red", "blue", "Tom", "Anna", "Bob", "5", "7", "12", "km", "goes", "to"]
    words = lambda n: [r.choice(some) for _ in range(n)]
    items = [(i, " ".join(words(r.randint(2, 30)))) for i in range(12)]
    docs = []
    items += [(i, " ".join(words(r.randint(60, 120)) + [f"w{k}" for k in range(60)])) for i in (12, 13)]
    for d in range(60):
        w = r.choice(items)[1].split(" ")
        for _ in range(r.randint(0, 3) if len(w) < 60 else r.randint(0, 24)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice(([], [r.choice(some)], [w[k], r.choice(some)]))
        docs.append((d, " ".join(words(r.randint(0, 8)) + w + words(r.randint(0, 8)))))
    told = lambda df: {r[0]: (r[1], r[2]) for r in df.select(df.columns[0], D.canonical_tokens(df.text), D.slot_tokens(df.text)).collect()}
    i, d = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    want = plain_leaks(told(d), told(i), 4, 0.5)
    assert {(x.doc_id, x.item_id) for x in D.leaks(d, i, window=4).collect()} == want and 5 < len(want) < 600


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_base(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if pii.is_card(m[0])]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_base_spans(seed):
    r = random.Random(seed)
    t = "".join(r.choice(["a", "@", ".", "-", "+", " ", "1", "25", "255", "256", "é", "(", ")", "4417 4672 1060 7149", "b@c.d", "1.2.3.4", "%", "\n"]) for _ in range(120))
    assert pii.base_spans(t) == plain_base(t)


def test_base_is_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "1 " * 150_000):
        pii.base_spans(t)


def test_tagger_on_held_out_windows():
    p = tagger.trained()
    x, y = tagger.labelled(400, 12345)
    g = tagger.decode(p, x)
    assert (g == y)[x > 0].mean() > 0.97
    hit = sum(((g > 0) & (y > 0)).any(1)) / max(1, (y > 0).any(1).sum())
    assert hit > 0.9


def test_windows_cover_and_agree():
    m = pii.Tagger(tagger.trained())
    t = prose(40, 11) + " call (555) 123-4567 now " + prose(200, 12) + " jo [at] mail.example [dot] com"
    whole = m.tags([t])[0]
    assert len(whole) == len(t) and (m.tags([t, "", t])[2] == whole).all()
    spans = pii.find([t], m)[0][1]
    assert ("phone", "(555) 123-4567") in [(pii.KINDS[k], t[s:e]) for s, k, e in spans]
    m.batch = 1
    assert (m.tags([t])[0] == whole).all()


def plain_tags(weights, text):
    """All windows, and one search over the whole text: emissions of tags other than outside count only near a trigger."""
    c, half = tagger.classes(text), tagger.LENGTH // 2
    total, weight = np.zeros((len(c), tagger.TAGS)), np.zeros(len(c))
    for lo in range(0, max(1, len(c) - half), half):
        x = np.zeros((1, tagger.LENGTH), np.uint8)
        n = min(tagger.LENGTH, len(c) - lo)
        x[0, :n] = c[lo : lo + n]
        tri = np.minimum(np.arange(n) + 1, n - np.arange(n))
        total[lo : lo + n] += tagger.emissions(weights, x)[0][:n, 0] * tri[:, None]
        weight[lo : lo + n] += tri
    e = total / weight[:, None]
    hot = [k for k, x in enumerate(text) if x in "0123456789@[("]
    far = np.array([all(abs(k - h) > pii.REACH for h in hot) for k in range(len(c))])
    e[far, 1:] = -1e6
    tr = weights["trans"] + tagger.ALLOWED
    score, back = e[0] + tagger._START, []
    for x in e[1:]:
        a = score[:, None] + tr
        back.append(a.argmax(0))
        score = a.max(0) + x
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1])


@pytest.mark.parametrize("seed", range(12))
def test_windows_that_are_left_out_change_nothing(seed):
    """Texts with and without spans, and spans longer than half a window, against a decoder that leaves nothing out."""
    m, r = pii.Tagger(tagger.trained()), random.Random(seed)
    some = [tagger._personal(r)[0] for _ in range(3)] + ["jo [at] mail.engineering.university.department.of.letters.example.org", "(555) 123-4567", " - ".join(["4417"] * 14)]
    texts = [prose(r.randint(0, 60), seed * 9 + k) + " " + r.choice(some) + " " + prose(r.randint(0, 90), seed * 9 + k + 5) for k in range(4)] + ["7", prose(40, seed)]
    got = m.tags(texts)
    assert sum(int(g.any()) for g in got) >= 2
    for t, g in zip(texts, got, strict=True):
        assert (g == plain_tags(m.weights, t)).all()


def test_spans_that_the_generator_does_not_make():
    """Hosts, names and numbers from outside the generator's lists."""
    m = pii.Tagger(tagger.trained())
    some = ["write to maria.lopez [at] bakery-shop.example [dot] org please", "call (415) 555-0132 after noon", "my number is 415-555-0198 thanks", "server 10[.]20[.]30[.]40 is down", "reach bob_smith (at) hospital.example (dot) net today", "card 4539.1488.0343.6467 was charged"]
    found = [bool(pii.find([t], m)[0][1]) for t in some]
    assert sum(found) >= 5, list(zip(some, found))


def test_detect_and_redact(spark):
    t = "mail a.b@c.de or 1.2.3.4, +1 (555) 123-4567 and 4417 1234 5678 9113 " + prose(10, 14)
    rows = [(1, t, "s"), (2, prose(90, 15), "s"), *ODD]
    got = {r.doc_id: r for r in pii.detect(frame(spark, rows)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(pii.told(plain_base(t)).encode()).hexdigest() and set(pii.told(plain_base(t)).split(",")) <= set(got[1].spans.split(","))
    assert got[2].spans == "" and pii.detect(frame(spark, rows)).count() == len(rows) and pii.detect(frame(spark, [])).collect() == []
    clean = {r.doc_id: r for r in pii.redact(frame(spark, rows)).collect()}
    assert clean[1].text.startswith("mail <EMAIL> or <IP>, <PHONE> and <CARD> ") and clean[1].n_chars == len(clean[1].text) and clean[2].text == rows[1][1] and clean[None].doc_id is None


# Token ids


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.mark.parametrize("seed", range(12))
def test_ids_equal_the_library(library, seed):
    r = random.Random(seed)
    e = pieces.Encoder(pieces.load())
    for t in ["".join(r.choice(["the", "a", " ", "  ", "\n", "é", "日", "ing", "x", ".", ",", "1", "\U0001f600", "tion"]) for _ in range(r.randint(0, 300))), "".join(r.choice("etaoinshr") for _ in range(1500)), " " * 60 + "x"]:
        got = np.frombuffer(e.encode(t), np.uint32).tolist()
        assert got == library.encode(t) and e.decode(got) == t


@pytest.mark.parametrize("ties", [False, True])
def test_pairs_that_merges_leave(ties):
    """fit() against the merges themselves, for all pairs of small vocabularies with much repetition; scores may be shared."""
    for seed in range(150):
        r = random.Random(seed)
        have = ["a", "b", "c"]
        rows = [(x, -1e9, "normal") for x in have]
        for k in range(r.randint(2, 16)):
            x = r.choice(have) + r.choice(have)
            if x not in have and len(x) < 14:
                have.append(x)
                rows.append((x, -float(k // 3 if ties else k), "normal"))
        v = pieces.Vocabulary(rows, "bpe")
        own = {i for p, i in v.ids.items() if v.merged(p) == [p]}
        assert {i for i in v.ids.values() if v.fit(-1, i)} == own
        for a in own:
            for b in v.ids.values():
                assert v.fit(a, b) == (v.merged(v.plain[a] + v.plain[b]) == [v.plain[a], v.plain[b]]), (seed, v.plain[a], v.plain[b])


def test_literal_space_mark_comes_back():
    e = pieces.Encoder(pieces.load())
    for t in ("a▁b", "▁", "▁ ▁"):
        assert e.decode(np.frombuffer(e.encode(t), np.uint32).tolist()) == t


def test_stream_is_bounded():
    e = pieces.Encoder(pieces.load())
    t = "".join(random.Random(1).choice("etaoinshrdlu") for _ in range(20_000))
    one = [i for part in e.stream([t]) for i in part]
    assert e.most_kept <= 8 * e.v.longest and one == [i for part in e.stream(t[k : k + 7] for k in range(0, len(t), 7)) for i in part]


def test_unigram_search():
    v = pieces.Vocabulary([("<unk>", 0, "unknown"), *((p, s, "normal") for p, s in (("▁a", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -2.5), ("▁ab", -4.0), ("ba", -1.5), ("▁", -3.0)))], "unigram")
    e = pieces.Encoder(v)

    def best(t):
        @__import__("functools").cache
        def go(i):
            return max(((v.score[v.ids[t[i:j]]] + go(j)[0], (t[i:j], *go(j)[1])) for j in range(i + 1, len(t) + 1) if t[i:j] in v.ids), default=(-1e9, ())) if i < len(t) else (0.0, ())

        return go(0)

    for k in range(200):
        t = "".join(random.Random(k).choice("ab ") for _ in range(1 + k % 15))
        ids = np.frombuffer(e.encode(t), np.uint32).tolist()
        assert sum(v.score[i] for i in ids) == pytest.approx(best(" " + t)[0]) and e.decode(ids) == t


def test_encoded_rows(spark):
    rows = [(1, prose(50, 16), "s"), *ODD]
    got = pieces.encoded(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.round_trip and len(r.ids) == r.n_ids for r in got)
    assert pieces.encoded(frame(spark, [])).collect() == []


# The pipeline


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    base = [prose(80, 400 + i) for i in range(6)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(10, base[1], "s"), (11, edited(base[2], 1, 1), "s"), (12, "short", "s"), (13, base[3] + " " + prose(30, 500), "s"), (14, prose(60, 501) + " a@b.com", "s"), *ODD]
    docs = frame(spark, rows)
    spark.createDataFrame([(1, prose(30, 500))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert docs.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = {r.doc_id: r for r in docs.collect()}
    # 13 has 80 of its 110 words in common with 3, so it is no copy, but it holds the benchmark item.
    assert set(got) == {0, 1, 2, 3, 4, 5, 14} and all(r.round_trip for r in got.values())
    assert pieces.Encoder(pieces.load()).decode(got[14].ids).endswith(" <EMAIL>")
