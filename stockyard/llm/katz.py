"""A Katz back-off model of n-grams with Good-Turing discounts, trained and evaluated over partitioned tables.

P(w | x) = d(c(xw)) c(xw) / c(x)       if the n-gram xw is in the training texts,
         = alpha(x) P(w | x')          else, alpha(x) = (1 - sum of the seen words' P(. | x)) / (1 - sum of the seen words' P(. | x')),
           x' being x without its first word: again an n-gram's P, down to the words;
         = P(w | x')                   if the context x isn't in the training texts,
P(w)     = d(c(w)) c(w) / N            if the word is in the training texts,
         = rest / unseen               else: the rest of the mass, shared by as many unseen words as there are words seen once.

A text is <s> w1 ... wn </s>, its first words have the contexts that it gives them; words are lower-cased in A-Z. d is Good-Turing's
discount for counts up to K, of its own for each length; where the counts of counts don't allow it, absolute discounting by
n1 / (n1 + 2 n2). A context without any count up to K has one phantom event in c(x), so that each context leaves some mass; every
distribution sums to one. The number of buckets and chunks changes no score.

The job never holds a vocabulary or a text collection in one place. Documents are packed into chunks of bounded size. Words go by hash to
buckets, which count them, number them and answer each chunk's words. Then, for each length from two to the order, the chunks' distinct
n-grams go to buckets by context (contexts with more tokens than a bucket's share are spread over several, whose counts of counts the
chunks add up), which count them, gather each context's counts of counts and answer: an n-gram's count is that of the longer ones' context.
At the end each chunk evaluates its texts token by token. What is sent is what is distinct in a chunk, packed as columns. Not sent is an
n-gram whose context or whose end isn't in the training texts, as its count is 0; nor one whose context is there once and in no held-out
text, as its count is 1 and nobody else asks for it: the buckets add the number of such ones to their counts of counts. Where the model is
kept, all are sent, and the buckets' counts are its tables, partitioned by kind; model_tables() gives them in plain columns.

Null texts are empty, a null id is a training text; repeated rows are texts of their own. Only id and text are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stockyard.llm import bytetext as B
from stockyard.llm import common as C

K = 5
ORDER = 3
CHUNK_TOKENS = 1_500_000
BUCKET_CHARS = 16_000_000
BOS, END, UNKNOWN = 0, 1, -1
_ROW = "kind string, chunk bigint, bucket int, data binary, stats array<bigint>"


# Packed columns


def pack(**columns) -> bytes:
    """Arrays as zstd-compressed byte planes of the shortest type; anything else as it is."""
    z = zstandard.ZstdCompressor(level=3)
    out = {}
    for k, v in columns.items():
        if isinstance(v, np.ndarray):
            kind = v.dtype
            if kind == np.int64:
                lo, hi = (int(v.min()), int(v.max())) if v.size else (0, 0)
                v = v.astype(next((t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max), kind))
            v = np.ascontiguousarray(v)
            out[k] = (kind.str, v.dtype.str, v.shape, z.compress(v.reshape(-1).view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes()))
        else:
            out[k] = v
    return pickle.dumps(out, 5)


def unpack(data: bytes) -> dict:
    d, out = zstandard.ZstdDecompressor(), {}
    for k, v in pickle.loads(data).items():
        if isinstance(v, tuple):
            kind, short, shape, raw = v
            v = np.ascontiguousarray(np.frombuffer(d.decompress(raw), np.uint8).reshape(np.dtype(short).itemsize, -1).T).reshape(-1).view(short).reshape(shape).astype(kind, copy=False)
        out[k] = v
    return out


def _row(kind: str, chunk: int, bucket: int, data: bytes, stats: list[int] | None = None) -> tuple:
    return kind, chunk, bucket, data, stats


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "chunk", "bucket", "data", "stats"])


# Estimates


def discounts(n: list[int]) -> np.ndarray:
    """d for counts 0 .. K (d[0] unused) from the counts of counts n[1] .. n[K + 1]."""
    d = np.ones(K + 1)
    if all(x > 0 for x in n[1 : K + 2]) and (common := (K + 1) * n[K + 1] / n[1]) < 1:
        for r in range(1, K + 1):
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        if ((d[1:] > 0) & (d[1:] < 1)).all():
            return d
    a = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5))
    d[1:] = (np.arange(1, K + 1) - a) / np.arange(1, K + 1)
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c > K, 1.0, d[np.clip(c, 0, K)]) * c


class Words:
    """The word distribution, from its totals alone."""

    def __init__(self, tokens: int, types: int, n: list[int], texts: int):
        self.tokens, self.types, self.texts, self.d = tokens, types, texts, discounts(n)
        rest = sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1))
        self.total = tokens if rest > 0 else tokens + 1
        self.unseen = max(1, n[1])
        self.rest = (rest if rest > 0 else 1) / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.total, self.rest / self.unseen)


def histogram(c: np.ndarray) -> list[int]:
    """How many counts are 0 .. K + 1."""
    return np.bincount(c[c <= K + 1], minlength=K + 2).tolist()


# Chunks


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int, chunk_tokens: int) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    ids, held, lengths, hashes, size = [], [], [], [], 0

    def flush():
        h, train = np.concatenate(hashes), ~np.repeat(np.concatenate(held), np.concatenate(lengths))
        u, at = np.unique(h, return_inverse=True)
        count = np.bincount(at[train], minlength=len(u)).astype(np.int64)
        chunk = (task << 24) + seq
        rows = [_row("docs", chunk, -1, pack(ids=[i for x in ids for i in x], held=np.concatenate(held), n=np.concatenate(lengths), at=at.astype(np.int32), words=len(u)))]
        edges = np.searchsorted(bucket_of(u, buckets), np.arange(buckets + 1))
        rows += [_row("asked", chunk, b, pack(h=u[lo:hi], c=count[lo:hi])) for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
        return _table(rows).to_batches()

    for b in batches:
        for lo, hi, data, at in B.slices(b.column(2)):
            low = B.LOWER[data]
            s, e, bounds = B.words(low, at)
            ids.append(b.column(0).slice(lo, hi - lo).to_pylist())
            held.append(np.array(b.column(1).slice(lo, hi - lo).to_pylist(), bool))
            lengths.append(np.diff(bounds))
            hashes.append(B.segments(low, s, e))
            size += len(s) + hi - lo
            if size >= chunk_tokens:
                yield from flush()
                ids, held, lengths, hashes, size, seq = [], [], [], [], 0, seq + 1
    if ids:
        yield from flush()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits, so buckets are ranges of sorted hashes."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _rows_of(table: pa.Table) -> list[dict]:
    return table.select(["kind", "chunk", "bucket", "data"]).to_pylist()


# Buckets of words


def _count_words(table: pa.Table, buckets: int, keep: bool) -> pa.Table:
    rows = sorted(_rows_of(table), key=lambda r: r["chunk"])
    bucket, got = rows[0]["bucket"], [unpack(r["data"]) for r in rows]
    u, at = np.unique(np.concatenate([g["h"] for g in got]), return_inverse=True)
    count = np.zeros(len(u), np.int64)
    np.add.at(count, at, np.concatenate([g["c"] for g in got]))
    # Numbers: frequent words of a bucket get small ones; words of held-out texts only get none.
    number = np.full(len(u), UNKNOWN, np.int64)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    number[order] = np.arange(len(order)) * buckets + bucket + 2
    known = count > 0
    model = pack(h=u[known], number=number[known], c=count[known]) if keep else None
    out = [_row("words", -1, bucket, model, [int(count.sum()), int(known.sum()), *histogram(count[known])])]
    ends = np.cumsum([len(g["h"]) for g in got])
    for r, lo, hi in zip(rows, [0, *ends[:-1]], ends, strict=True):
        out.append(_row("word-answer", r["chunk"], bucket, pack(number=number[at[lo:hi]], c=count[at[lo:hi]])))
    return _table(out)


# Chunks again: n-grams


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, of numbers from 0; where a number and its place fit in 63 bits, by sorting both as one."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()).bit_length() + bits > 63:
        return np.unique(key, return_inverse=True)
    x = key << bits
    x |= np.arange(len(key))
    x.sort()
    at = x & ((1 << bits) - 1)
    x >>= bits
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    x, rank = x[new], np.cumsum(new)
    rank -= 1
    inverse = np.empty(len(at), np.int64)
    inverse[at] = rank
    return x, inverse


def _at(values: np.ndarray, places: np.ndarray, none=0) -> np.ndarray:
    """The values at places, `none` at place -1."""
    return np.append(values, np.array([none], values.dtype))[places]


class Grams:
    """A chunk's distinct n-grams of one length, in the order of their words' numbers, and their contexts.

    context: that of each step of the texts, or -1; contexts: the words' numbers of each context, a column for each place; tokens: how
    often each context is in the training texts; told: whether a held-out text may have it; lower: each step's count of the n-gram without
    its first word.
    """

    def __init__(self, chunk: Chunk, context: np.ndarray, contexts: list[np.ndarray], tokens: np.ndarray, told: np.ndarray, lower: np.ndarray):
        buckets, number, w = chunk.buckets, chunk.number, chunk.w
        self.context, self.contexts, self.tokens, self.told = context, contexts, tokens, told
        there = _at(tokens, context) > 0
        # Others can't have been seen and aren't asked for.
        asked = there & (lower > 0)
        key, inverse = _distinct(context[asked] * len(number) + w[asked])
        self.of = np.full(len(w), -1, np.int64)
        self.of[asked] = inverse
        self.head, word = key // len(number), key % len(number)
        self.columns = [*(x[self.head] for x in contexts), number[word]]
        # A context that is there once and only in training texts has one n-gram, of count 1.
        once = ~told & (tokens == 1)
        self.once = once[self.head]
        sent = np.flatnonzero(~self.once)
        # Over how many buckets a context is spread: one for each half of a bucket's even share.
        parts = 1 + 2 * buckets * tokens // max(chunk.words.tokens, 1)
        part = (B.mix(self.columns[-1][sent].astype(np.uint64)) % parts[self.head[sent]].astype(np.uint64)).astype(np.int64)
        bucket = _home([x[sent] for x in self.columns[:-1]], part, buckets)
        by = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        self.order, self.edges = sent[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
        # What contexts of held-out texts leave to unseen words, and whether a spread context has a phantom event, is asked of every
        # bucket that holds a part of them.
        self.wide = (parts > 1) & ~once
        need = np.zeros(len(tokens), bool)
        need[context[there & chunk.held[chunk.doc]]] = True
        if self.wide.any():
            here = np.zeros(len(tokens), bool)
            here[context[there]] = True
            need |= here & self.wide
        need = np.flatnonzero(need)
        parts = parts[need]
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        need = np.repeat(need, parts)
        # Once a bucket, also where several parts of a context share one.
        both = np.unique(_home([x[need] for x in contexts], part, buckets) * len(tokens) + need)
        self.need, self.need_edges = both % max(len(tokens), 1), np.searchsorted(both // max(len(tokens), 1), np.arange(buckets + 1))

    def asked(self, chunk: Chunk, number: int) -> list[tuple]:
        known, held = self.of >= 0, chunk.held[chunk.doc]
        count = np.bincount(self.of[known & ~held], minlength=len(self.head)).astype(np.int64)
        told = np.zeros(len(count), bool)
        told[self.of[known & held]] = True
        # The shorter n-gram's probability is needed of contexts that a held-out text has.
        lower, size = np.zeros(len(count), np.int64), np.zeros(len(self.tokens), np.int64)
        lower[self.of[known]] = chunk.lower[known]
        lower[~self.told[self.head]] = 0
        size[self.context[known]] = chunk.size[known]
        size[~self.told] = 0
        once, out = int(self.once.sum()), []
        for b in range(len(self.edges) - 1):
            g, need = self.order[self.edges[b] : self.edges[b + 1]], self.need[self.need_edges[b] : self.need_edges[b + 1]]
            if len(g) or len(need) or once:
                head = self.head[g]
                runs = np.flatnonzero(np.diff(head, prepend=-1))
                first = head[runs]
                at = np.concatenate([first, need])
                data = pack(runs=np.diff(runs, append=len(g)), size=size[first], need=len(need), w=self.columns[-1][g], c=count[g], told=told[g], lower=lower[g], once=once, x0=np.diff(self.contexts[0][at], prepend=0), **{f"x{i}": x[at] for i, x in enumerate(self.contexts) if i})
                out.append(_row("asked", number, b, data))
                once = 0
        return out

    def answered(self, answers: list[dict], d: np.ndarray, p: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Each n-gram's count and whether a held-out text may have it; each step's count, its context's size and, from the shorter n-gram's p, its probability."""
        got = [unpack(r["data"]) for r in sorted(answers, key=lambda r: r["bucket"])]
        join = lambda k, kind: np.concatenate([np.zeros(0, kind), *(g[k] for g in got)]).astype(kind)
        signed = join("c", np.int64)
        count, phantom, told = self.once.astype(np.int64), np.zeros(len(self.once), bool), np.zeros(len(self.once), bool)
        count[self.order], phantom[self.order], told[self.order] = np.abs(signed), signed < 0, join("told", bool)
        # A context's counts of counts: its parts add up.
        t = np.concatenate([np.zeros((0, K + 1), np.int64), *(g["t"] for g in got)])
        n, r = len(self.tokens), np.arange(1, K + 1)
        add = lambda x: np.bincount(self.need, x, n)
        spare = (add(t[:, 1:].sum(1)) == 0).astype(np.int64)
        c = _at(count, self.of)
        size = _at(self.tokens + np.where(self.wide, spare, 0), self.context) + _at(phantom & ~self.wide[self.head], self.of)
        if p is not None:
            tokens, lower = add(t[:, 0]), add(join("pw", np.float64))
            kept = tokens - add(t[:, 1:] @ ((1 - d[r]) * r))
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = (1 - kept / (self.tokens + spare)) / np.maximum(1 - lower, 1e-15)
            p *= _at(np.where((self.tokens > 0) & (tokens > 0), alpha, 1.0), self.context, 1)
            seen = c > 0
            p[seen] = discounted(c[seen], d) / size[seen]
        return count, told, c, size, p


class Chunk:
    """A chunk's texts with its words' numbers and counts, and its n-grams of every length that was answered and of the next."""

    def __init__(self, rows: list[dict], words: Words, d: list[np.ndarray], buckets: int, order: int):
        """d: the discounts of lengths 2, 3, ... as far as they were counted; probabilities are there if that is up to the order."""
        self.words, self.buckets = words, buckets
        docs = unpack(next(r["data"] for r in rows if r["kind"] == "docs"))
        got = [unpack(r["data"]) for r in sorted((r for r in rows if r["kind"] == "word-answer"), key=lambda r: r["bucket"])]
        self.ids, self.held, self.n, at = docs["ids"], docs["held"], docs["n"], docs["at"].astype(np.int64)
        # Local words: <s>, </s> and the chunk's own, in the order of their numbers, so that n-grams come in that order; steps of text i:
        # n[i] + 1, the last to </s>.
        number = np.concatenate([[BOS, END], *(g["number"] for g in got)])
        by = np.argsort(number, kind="stable")
        local = np.empty_like(by)
        local[by] = np.arange(len(by))
        self.number, self.c = number[by], np.concatenate([[words.texts, words.texts], *(g["c"] for g in got)])[by]
        self.steps = self.n + 1
        ends = np.cumsum(self.steps)
        self.w = np.empty(int(ends[-1]), np.int64)
        last = np.zeros(len(self.w), bool)
        last[ends - 1] = True
        self.w[last], self.w[~last] = local[1], local[at + 2]
        first = ends - self.steps
        self.doc = np.repeat(np.arange(len(self.n)), self.steps)
        context = np.empty_like(self.w)
        context[1:] = self.w[:-1]
        context[first] = local[0]
        self.lower, self.size = self.c[self.w], np.full(len(self.w), words.total)
        del docs, got, at, number, by, local, last
        self.p = words.p(self.lower) if len(d) == order - 1 else None
        self.grams = Grams(self, context, [self.number], self.c, np.ones(len(self.c), bool), self.lower)
        for m, dm in enumerate(d, 2):
            g, self.grams, self.lower, self.size = self.grams, None, None, None
            count, told, self.lower, self.size, self.p = g.answered([r for r in rows if r["kind"] == f"answer-{m}"], dm, self.p)
            if m < order:
                # An n-gram is the context of what follows it in its text.
                context = np.full(len(self.w), -1, np.int64)
                context[1:] = g.of[:-1]
                context[first] = -1
                # One length at a time: what the shorter one needed is dropped first.
                columns = g.columns
                del g
                self.grams = Grams(self, context, columns, count, told, self.lower)

    def scores(self) -> dict[str, np.ndarray]:
        cw = self.c[self.w]
        base = np.log10((cw + 1) / (self.words.tokens + self.words.types + 1))
        add = lambda x: np.bincount(self.doc, x, len(self.n))
        return {"n_tokens": self.steps, "n_known": add(cw > 0).astype(np.int64), "base_score": add(base), "score": add(np.log10(self.p))}


def _home(context: list[np.ndarray], part: np.ndarray, buckets: int) -> np.ndarray:
    h = context[0].astype(np.uint64)
    for x in [*context[1:], part]:
        h = B.mix(h * np.uint64(B.BYTE_BASE) + x.astype(np.uint64) + np.uint64(1))
    return (h % np.uint64(buckets)).astype(np.int64)


# Buckets of n-grams


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, another for another pair: of their ranks where the numbers are too long for that."""
    if len(a) and (a.max() >> 31 or b.max() >> 32):
        a, b = (np.unique(x, return_inverse=True)[1] for x in (a, b))
    return (a << 32) | b


def _count_grams(table: pa.Table, m: int, lower_d: np.ndarray, keep: bool) -> pa.Table:
    rows = sorted(_rows_of(table), key=lambda r: r["chunk"])
    bucket, got = rows[0]["bucket"], [unpack(r["data"]) for r in rows]
    join = lambda k: np.concatenate([g[k] for g in got])
    contexts = [np.concatenate([np.cumsum(g["x0"]) for g in got]), *(join(f"x{i}") for i in range(1, m - 1))]
    key = contexts[0]
    for x in contexts[1:]:
        key = _joined(key, x)
    key, head = np.unique(key, return_inverse=True)
    size_at = np.cumsum([len(g["runs"]) + g["need"] for g in got])
    asks, asked = [], []
    for g, hi in zip(got, size_at, strict=True):
        mid = hi - g["need"]
        asks.append(head[mid - len(g["runs"]) : mid])
        asked.append(head[mid:hi])
    size = np.ones(len(key), np.int64)
    size[np.concatenate(asks)] = join("size")
    w = join("w")
    gram, of = np.unique(_joined(np.repeat(np.concatenate(asks), join("runs")), w), return_inverse=True)
    count = np.bincount(of, join("c"), len(gram)).astype(np.int64)
    uc, uw, lower = (np.zeros(len(gram), np.int64) for _ in range(3))
    uc[of], uw[of], lower[of] = np.repeat(np.concatenate(asks), join("runs")), w, join("lower")
    seen = count > 0
    at, sc = uc[seen], count[seen]
    t = np.zeros((len(key), K + 1), np.int64)
    t[:, 0] = np.bincount(at, sc, len(key))
    for r in range(1, K + 1):
        t[:, r] = np.bincount(at[sc == r], minlength=len(key))
    pw = np.bincount(at, discounted(lower[seen], lower_d) / np.maximum(size[at], 1), len(key))
    # Where all n-grams are wanted here, all contexts are called known to held-out texts.
    told = np.full(len(gram), keep)
    told[of[join("told")]] = True
    # A negative count: what is here of the context has no count up to K, so it has a phantom event if it isn't spread.
    sign = np.where(t[:, 1:].sum(1) == 0, -1, 1)
    model = None
    if keep:
        there, x = t[:, 0] > 0, [np.zeros(len(key), np.int64) for _ in contexts]
        for a, b in zip(x, contexts, strict=True):
            a[head] = b
        model = pack(w=uw[seen], c=sc, tokens=t[there], pw=pw[there], **{f"x{i}": a[at] for i, a in enumerate(x)}, **{f"y{i}": a[there] for i, a in enumerate(x)})
    once, n = sum(g["once"] for g in got), histogram(sc)
    n[1] += once
    out = [_row("grams", -1, bucket, model, [int(sc.sum()) + once, int(seen.sum()) + once, *n])]
    count *= sign[uc]
    ends = np.cumsum([len(g["w"]) for g in got])
    for r, k, lo, hi in zip(rows, asked, [0, *ends[:-1]], ends, strict=True):
        out.append(_row(f"answer-{m}", r["chunk"], bucket, pack(c=count[of[lo:hi]], told=told[of[lo:hi]], t=t[k], pw=pw[k])))
    return _table(out)


# The job


def held_out(doc_id: Column, modulus: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == held, F.lit(False))


def _totals(table: DataFrame, kind: str) -> list[int]:
    got = table.filter(F.col("kind") == kind).agg(*[F.coalesce(F.sum(F.element_at("stats", i)), F.lit(0)) for i in range(1, K + 5)]).first()
    return [int(x) for x in got]


def model_tables(counted: DataFrame, grams: list[DataFrame], words: Words, d: list[np.ndarray]) -> dict[str, DataFrame]:
    """The model in plain columns, from the buckets' tables; d: the discounts of lengths 2, 3, ...

    words (hash, word, count, probability), word -1 being all unseen words together; contexts (context, tokens, backoff); pairs (context,
    word, count, probability). Contexts and words are called by number: 0 is <s>, 1 is </s>. For each longer n, contexts<n> and grams<n>
    with the same columns, but the context's words as context1, context2, ...
    """

    def unpacked(names, kinds, columns):
        def rows(batches):
            for b in batches:
                for data in b.column("data").to_pylist():
                    got = columns(unpack(data))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == "bigint" else pa.float64()) for x, k in zip(got, kinds, strict=True)], names)

        return rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))

    def table(df, kind, names, kinds, columns):
        return df.filter(F.col("kind") == kind).select("data").mapInArrow(*unpacked(names, kinds, columns))

    def of_length(m, df, dm):
        x = ["context"] if m == 2 else [f"context{i}" for i in range(1, m)]
        low = [f"n{r}" for r in range(1, K + 1)]
        parts = table(df, "grams", [*x, "tokens", *low, "lower"], ["bigint"] * (m + K) + ["double"], lambda g: (*(g[f"y{i}"] for i in range(m - 1)), *(np.ascontiguousarray(g["tokens"][:, r]) for r in range(K + 1)), g["pw"]))
        whole = parts.groupBy(*x).agg(*[F.sum(c).alias(c) for c in ("tokens", *low, "lower")])
        bare = (sum((F.col(c) for c in low[1:]), F.col(low[0])) == 0).cast("int")
        kept = F.col("tokens") - sum((F.lit(float((1 - dm[r]) * r)) * F.col(low[r - 1]) for r in range(1, K + 1)), F.lit(0.0))
        whole = whole.select(*x, "tokens", (F.col("tokens") + bare).alias("_total"), ((1 - kept / (F.col("tokens") + bare)) / F.greatest(1 - F.col("lower"), F.lit(1e-15))).alias("backoff"))
        seen = table(df, "grams", [*x, "word", "count", "_kept"], ["bigint"] * (m + 1) + ["double"], lambda g: (*(g[f"x{i}"] for i in range(m - 1)), g["w"], g["c"], discounted(g["c"], dm).astype(np.float64)))
        return whole.drop("_total"), seen.join(whole, x).select(*x, "word", "count", (F.col("_kept") / F.col("_total")).alias("probability"))

    spark = counted.sparkSession
    known = table(counted, "words", ["hash", "word", "count", "probability"], ["bigint", "bigint", "bigint", "double"], lambda g: (g["h"].view(np.int64), g["number"], g["c"], words.p(g["c"])))
    texts = np.array([words.texts] if words.texts else [], np.int64)
    ends = [(None, END, int(c), float(p)) for c, p in zip(texts, words.p(texts), strict=True)]
    unseen = [(None, UNKNOWN, 0, float(words.rest))]
    out = {"words": known.unionByName(spark.createDataFrame(ends + unseen, "hash bigint, word bigint, count bigint, probability double"))}
    for m, (df, dm) in enumerate(zip(grams, d, strict=True), 2):
        names = ("contexts", "pairs") if m == 2 else (f"contexts{m}", f"grams{m}")
        out |= dict(zip(names, of_length(m, df, dm), strict=True))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, keep_model: str | None = None, chunk_tokens: int = CHUNK_TOKENS, bucket_chars: int = BUCKET_CHARS, order: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, by n-grams of up to `order` words.

    keep_model: a folder that gets model_tables().
    """
    if order < 2:
        raise ValueError("order is the length of the longest n-grams, two at least")
    C.bounded_batches(docs.sparkSession)
    spark, keep = docs.sparkSession, keep_model is not None
    held = held_out(C.col(id_col)) if held is None else held
    src = docs.select(C.col(id_col).alias("id"), held.alias("held"), C.col(text_col).cast("string").alias("text"))
    chars = src.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-int(chars) // bucket_chars))
    texts = src.filter("not held").count()
    chunks, chunk_path = C.written(src.mapInArrow(lambda x: _chunks(x, buckets, chunk_tokens), _ROW), "katz-chunks", ("kind",))
    asked = chunks.filter("kind = 'asked'").repartition(buckets, "bucket")
    counted, _ = C.written(asked.groupBy("bucket").applyInArrow(lambda t: _count_words(t, buckets, keep), _ROW), "katz-words", ("kind",))
    tokens, types, *n = _totals(counted, "words")
    if texts <= K + 1:
        n[texts] += 1
    words = Words(tokens + texts, types + (texts > 0), n, texts)
    # Counted: nothing reads them again.
    C.drop_path(spark, f"{chunk_path}/kind=asked")
    C.release(spark)
    known = chunks.filter("kind = 'docs'").unionByName(counted.filter("kind = 'word-answer'"))
    grams, d = [], []
    for m in range(2, order + 1):
        ask, count = _asking(words, list(d), buckets, m), _counting(m, d[-1] if d else words.d, keep)
        asked = known.groupBy("chunk").applyInArrow(ask, _ROW).repartition(buckets, "bucket")
        table, _ = C.written(asked.groupBy("bucket").applyInArrow(count, _ROW), f"katz-{m}-grams", ("kind",))
        _, _, *n = _totals(table, "grams")
        grams.append(table)
        d.append(discounts(n))
        known = known.unionByName(table.filter(F.col("kind") == f"answer-{m}"))
        C.release(spark)
    kind, id_type = dict(docs.dtypes)[id_col], to_arrow_type(docs.schema[id_col].dataType)

    def evaluate(t: pa.Table) -> pa.Table:
        c = Chunk(_rows_of(t), words, d, buckets, order)
        got = c.scores()
        return pa.table({"id": pa.array(c.ids, id_type), "held_out": pa.array(c.held), "n_tokens": got["n_tokens"].astype(np.int64), "n_known": got["n_known"], "train_tokens": np.full(len(c.n), words.tokens, np.int64), "base_score": got["base_score"], "score": got["score"]})

    out = known.groupBy("chunk").applyInArrow(evaluate, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    if keep:
        for name, table in model_tables(counted, grams, words, d).items():
            table.write.parquet(f"{keep_model}/{name}")
    return out.withColumnRenamed("id", id_col)


def _asking(words: Words, d: list[np.ndarray], buckets: int, m: int):
    def ask(t: pa.Table) -> pa.Table:
        rows = _rows_of(t)
        c = Chunk(rows, words, d, buckets, m)
        return _table(c.grams.asked(c, rows[0]["chunk"]))

    return ask


def _counting(m: int, lower_d: np.ndarray, keep: bool):
    return lambda t: _count_grams(t, m, lower_d, keep)


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=ORDER)


QUERIES = {"op1_katz": op1_katz}
ORACLE_SQL: dict[str, str] = {}
