"""The Katz model against a plain one in one place."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stockyard.llm import katz as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs):
    """(id -> (held, n, known, N, base, score)), and P as a function: everything from counts in dicts."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, WORD.findall((t or "").translate(low))) for i, t in docs]
    one, two = Counter(), defaultdict(Counter)
    for _, held, w in toks:
        if not held:
            one.update([*w, "</s>"])
            for a, b in zip(["<s>", *w], [*w, "</s>"]):
                two[a][b] += 1
    texts, n, v = one["</s>"], sum(one.values()), len([x for x in one if one[x]])
    hist = lambda cs: (lambda x: [x[r] for r in range(M.K + 2)])(Counter(cs))
    d1, d2 = M.discounts(hist(one.values())), M.discounts(hist(c for x in two.values() for c in x.values()))
    dd = lambda c, d: c if c > M.K else d[c] * c
    rest = n - sum(dd(c, d1) for c in one.values() if c)
    total = n if rest > 1e-9 else n + 1
    unseen = max(1, sum(1 for c in one.values() if c == 1))
    p1 = lambda w: dd(one[w], d1) / total if one[w] else (total - sum(dd(c, d1) for c in one.values() if c)) / total / unseen
    size = lambda a: texts if a == "<s>" else one[a]

    def p2(a, w):
        if a not in two:
            return p1(w)
        c = size(a) + all(x > M.K for x in two[a].values() if x)
        if two[a][w]:
            return dd(two[a][w], d2) / c
        kept, lower = sum(dd(x, d2) for x in two[a].values() if x) / c, sum(p1(x) for x in two[a] if two[a][x])
        return (1 - kept) / max(1 - lower, 1e-15) * p1(w)

    out = {}
    for i, held, w in toks:
        seq = [*w, "</s>"]
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in seq)
        out[i] = (held, len(seq), sum(one[x] > 0 for x in seq), n, base, sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *w], seq)))
    return out, p2, [x for x in one if one[x]], two, unseen


def made(n=160, seed=5):
    g = np.random.default_rng(seed)
    vocabulary = ["the", "of", "And", "a,"] + [f"w{k}é" for k in range(60)]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    texts = [" ".join(g.choice(vocabulary, g.integers(0, 40), p=weights / weights.sum())) for _ in range(n)]
    return [(k, t) for k, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "THE the\tThe\n" * 200), (None, "of the of")]


@pytest.mark.parametrize("size, buckets", [(3, 8), (160, 8), (160, 50), (160, 500)])
def test_equals_plain(spark, size, buckets):
    """Several chunks a task; the number of buckets, and so which contexts are spread over several, changes no score."""
    docs = made(size)
    want, *_ = plain(docs)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, score int").repartition(3)
    chars = sum(len(t or "") for _, t in docs)
    rows = M.score(df, chunk_tokens=300, bucket_chars=max(1, chars // buckets)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        held, n, known, tokens, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)


def test_sums_to_one():
    _, p2, vocabulary, two, unseen = plain(made())
    for a in [*two, "never"]:
        assert sum(p2(a, w) for w in vocabulary) + unseen * p2(a, "never seen") == pytest.approx(1)


def test_the_stored_model_sums_to_one(spark, tmp_path):
    """The operator's own tables: each context's pairs and what it backs off with."""
    docs = made()
    _, p2, _, two, _ = plain(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    M.score(df, keep_model=str(tmp_path / "model"), chunk_tokens=300, bucket_chars=200).count()
    words, contexts, pairs = (spark.read.parquet(str(tmp_path / "model" / t)).collect() for t in ("words", "contexts", "pairs"))
    one = {r.word: r.probability for r in words}
    assert sum(one.values()) == pytest.approx(1) and len(one) == len(words)
    seen = defaultdict(dict)
    for r in pairs:
        seen[r.context][r.word] = r.probability
    assert len(contexts) == len(seen) == len(two)
    for r in contexts:
        assert sum(seen[r.context].values()) + r.backoff * (1 - sum(one[w] for w in seen[r.context])) == pytest.approx(1)


def test_no_rows(spark):
    assert M.score(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_all_held_out(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = M.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id bigint, text string")).collect()
    assert [r.train_tokens for r in rows] == [0, 0, 0] and all(np.isfinite(r.score) for r in rows)


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "decimal(12,2)", "date"])
def test_ids_of_any_type(spark, kind):
    """Also where all ids of a chunk are null."""
    df = spark.createDataFrame([(None, "a b")] * 4 + [(10, "b a c"), (None, None)], "n int, text string").repartition(4)
    made_of = {"date": "date_add(DATE'2020-01-01', n)"}.get(kind, f"CAST(n AS {kind})")
    df = df.selectExpr(f"{made_of} AS `doc.id`", "text")
    for d in (df, df.where("n IS NULL") if "n" in df.columns else df.where("`doc.id` IS NULL")):
        got = M.score(d, "doc.id")
        assert dict(got.dtypes)["doc.id"] == kind and sorted(r.n_tokens for r in got.collect()) == sorted(1 if r.text is None else len(r.text.split()) + 1 for r in d.collect())


def recursive(docs, order):
    """(id -> score), and P as a function, by n-grams of up to `order` words: back-off written as the recursion that it is."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, ["<s>", *WORD.findall((t or "").translate(low)), "</s>"]) for i, t in docs]
    follow = [defaultdict(Counter) for _ in range(order)]
    for _, held, w in toks:
        if not held:
            for j in range(1, len(w)):
                for m in range(min(order, j + 1)):
                    follow[m][tuple(w[j - m : j])][w[j]] += 1
    hist = lambda cs: (lambda x: [x[r] for r in range(M.K + 2)])(Counter(cs))
    d = [M.discounts(hist(c for x in f.values() for c in x.values())) for f in follow]
    keep = lambda c, m: c if c > M.K else d[m][c] * c
    one = follow[0][()]
    n, kept = sum(one.values()), sum(keep(c, 0) for c in one.values())
    total, unseen = n + (n - kept <= 1e-9), max(1, sum(c == 1 for c in one.values()))
    alphas = {}

    def alpha(x):
        if x not in alphas:
            seen = follow[len(x)][x]
            size = sum(seen.values()) + all(c > M.K for c in seen.values())
            left = 1 - sum(keep(c, len(x)) for c in seen.values()) / size
            alphas[x] = size, left / max(1 - sum(p(x[1:], w) for w in seen), 1e-15)
        return alphas[x]

    def p(x, w):
        if not x:
            return keep(one[w], 0) / total if one[w] else (total - kept) / total / unseen
        if x not in follow[len(x)]:
            return p(x[1:], w)
        size, back = alpha(x)
        return keep(c, len(x)) / size if (c := follow[len(x)][x].get(w)) else back * p(x[1:], w)

    return {i: sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w))) for i, _, w in toks}, p, follow, unseen


def phrases(n=160, seed=11):
    """Texts of repeated phrases, so that contexts of two and three words are seen, unseen, frequent and without small counts."""
    g = np.random.default_rng(seed)
    parts = ["the cat sat on", "The dog", "of the cat", "a dog sat", "on the mat", *(f"w{k}é the" for k in range(30))]
    weights = 1 / np.arange(1, len(parts) + 1)
    return [(k, " ".join(g.choice(parts, g.integers(0, 14), p=weights / weights.sum()))) for k in range(n)] + [(n, None), (n + 1, "x"), (n + 2, "the cat " * 300), (None, "of the cat sat")]


@pytest.mark.parametrize("order, buckets", [(2, 8), (3, 8), (3, 50), (3, 500), (4, 20)])
def test_backs_off_from_every_length(spark, order, buckets):
    docs = phrases()
    want, *_ = recursive(docs, order)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = M.score(df, chunk_tokens=300, bucket_chars=max(1, sum(len(t or "") for _, t in docs) // buckets), order=order).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx(want, rel=1e-9)


def test_the_query_scores_by_three_words(spark, tmp_path):
    docs = phrases(40)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, *_ = recursive(docs, 3)
    assert {r.doc_id: r.score for r in M.op1_katz(spark, str(tmp_path)).collect()} == pytest.approx(want, rel=1e-9)


def test_three_words_sum_to_one(spark, tmp_path):
    """By the plain recursion, and by the stored tables."""
    docs = phrases(60)
    _, p, follow, unseen = recursive(docs, 3)
    for x in [*follow[2], ("never", "the"), ("the", "never")]:
        assert sum(p(x, w) for w in follow[0][()]) + unseen * p(x, "never seen") == pytest.approx(1)
    M.score(spark.createDataFrame(docs, "doc_id bigint, text string"), keep_model=str(tmp_path / "model"), chunk_tokens=300, bucket_chars=200, order=3)
    pairs, contexts, grams = (spark.read.parquet(str(tmp_path / "model" / t)).collect() for t in ("pairs", "contexts3", "grams3"))
    two, seen = {(r.context, r.word): r.probability for r in pairs}, defaultdict(dict)
    for r in grams:
        seen[r.context1, r.context2][r.word] = r.probability
    assert len(contexts) == len(seen) == len(follow[2])
    for r in contexts:
        x = seen[r.context1, r.context2]
        assert sum(x.values()) + r.backoff * (1 - sum(two[r.context2, w] for w in x)) == pytest.approx(1)


def test_ranks_for_long_numbers():
    a, b = np.array([1 << 40, 5, 5, 1 << 40]), np.array([2, 1 << 33, 2, 2])
    assert len(set(M._joined(a, b).tolist())) == 3


@pytest.mark.parametrize("order", [3, 4])
@pytest.mark.parametrize("shared", [True, False])
def test_contexts_seen_once(spark, order, shared):
    """Of training texts only, or asked for by held-out texts of another chunk too."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [i for i in range(200) if i not in held]
    docs = [(i, f"p{i} q{i} r{i} s{i} t{i} p{i} q{i} u{i}") for i in train[:6]]
    docs += [(h, f"p{i} q{i} r{i} t{i} r{i} s{i} t{i} never r{i} s{i} u{i}" if shared else f"x{i} y{i}") for h, i in zip(held, train[:4], strict=False)]
    want, *_ = recursive(docs, order)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    rows = M.score(df, chunk_tokens=10, bucket_chars=20, order=order).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("top", [50, 1 << 40, 1 << 62])
def test_distinct_numbers(top):
    key = np.random.default_rng(3).integers(0, 40, 1000) * (top // 40)
    for x in (key, key[:1], key[:0]):
        assert [a.tolist() for a in M._distinct(x)] == [a.tolist() for a in np.unique(x, return_inverse=True)]
