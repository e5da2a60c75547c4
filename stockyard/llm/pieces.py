"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search goes through a text once and keeps a window of the last max_piece positions, each with its best way in. Whenever the ways back
from all positions of the window meet in one boundary, what lies before it can't change any more: its ids are committed and forgotten. So
memory is bounded by the piece length, not the text, apart from runs that stay undecided.

Two kinds of model share the search. "unigram": the best way is that with the highest sum of scores. "bpe": a prefix has exactly one
valid last piece, the one that the merges of (piece before, piece) alone would leave as two; scores rank the merges. Both give what the
reference encoder of that model kind gives.

No piece of usual models holds a space after another character, so a text falls into runs "spaces, then others" at whose borders all ways
meet, as they do between two characters that no piece holds side by side. Every stretch between two such boundaries goes through the
same search, however long it is. The distinct stretches of up to MEMO characters of a block of text are searched in order, so that each
goes on from where it leaves the one before it, and remembered in a bounded memo. A model with pieces across spaces is searched as one run. Ties (unigram): the way whose last piece is longest; BPE merges break ties by place.

Unknown characters become byte pieces (or the unknown piece, if the model has none). U+2581 in a text is one of them, so that decoding
gives it back; everything else encodes as usual: a space is put before a text that isn't empty.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import bytetext as B
from stockyard.llm import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MEMO, MEMO_SIZE = 40, 400_000
#: Characters whose distinct runs are searched together.
BLOCK = 1 << 20
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_RUNS = re.compile(r" +[^ ]*|[^ ]+")


class Vocabulary:
    """Pieces by id with their scores: plain data, of the model's size (bounded), so it can be sent to the workers."""

    def __init__(self, pieces: list[tuple[str, float, str]], kind: str):
        self.kind = kind
        self.text: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.plain: dict[int, str] = {}
        self.score: list[float] = []
        self.bytes = [-1] * 256
        self.unknown = 0
        for i, (piece, score, what) in enumerate(pieces):
            self.score.append(score)
            if what == "byte":
                self.bytes[int(_BYTE.fullmatch(piece)[1], 16)] = i
                self.text.append(bytes([int(_BYTE.fullmatch(piece)[1], 16)]))
            elif what == "normal":
                plain = piece.replace("▁", " ")
                self.ids[plain] = i
                self.plain[i] = plain
                self.text.append(plain.encode())
            else:
                self.unknown = i if what == "unknown" else self.unknown
                self.text.append("⁇".encode() if what == "unknown" else b"")
        self.longest = max(map(len, self.ids), default=1)
        #: Pairs of characters that some piece holds side by side; between any other two there is always a boundary.
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.splits = not any(" " in p.lstrip(" ") for p in self.ids)
        self.floor = min(self.score, default=0.0) - 10
        #: By their last three characters, the lengths of the longer pieces, longest first.
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                tails.setdefault(p[-3:], set()).add(len(p))
        self.tails = {t: tuple(sorted(n, reverse=True)) for t, n in tails.items()}
        #: BPE: a piece's place in the order of merges (-1: a character), and the two pieces that its last merge joins (none: merges never make it).
        self.rank: list[int] = [-1] * len(pieces)
        self.halves: dict[int, tuple[int, int]] = {}
        #: Pieces with a merge in them whose score another merge shares: where they go first depends on their places in the text.
        self.tied: set[int] = set()
        if kind == "bpe":
            for r, i in enumerate(sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: -self.score[i])):
                self.rank[i] = r
            shared = Counter(self.score[i] for p, i in self.ids.items() if len(p) > 1)
            for p in sorted(self.ids, key=len):
                parts, i = self.merged(p, 2), self.ids[p]
                if len(p) > 1 and len(parts) == 2:
                    self.halves[i] = (self.ids[parts[0]], self.ids[parts[1]])
                    if shared[self.score[i]] > 1 or not self.tied.isdisjoint(self.halves[i]):
                        self.tied.add(i)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The merges of a short text until so many parts are left, best score first, leftmost on ties."""
        parts, ids, score = list(text), self.ids, self.score
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, before: int, piece: int) -> bool:
        """Whether the merges leave the piece as it is behind the piece `before`, or on its own (-1).

        Both pieces are taken apart, the later merge first, down to the characters where they meet. At each step the two parts that
        touch stood side by side once; had their own merge come before the one just undone (or at the same place in the order, farther left), it would have crossed.
        """
        rank, halves, ids, text = self.rank, self.halves, self.ids, self.plain
        if rank[piece] >= 0 and piece not in halves:
            return False
        if before in self.tied or piece in self.tied:
            both = [text[before], text[piece]] if before >= 0 else [text[piece]]
            return self.merged("".join(both)) == both
        limit = len(rank)
        while before >= 0:
            cross = ids.get(text[before] + text[piece])
            if cross is not None and rank[cross] < limit:
                return False
            if rank[before] > rank[piece]:
                limit = rank[before]
                before = halves[before][1]
            elif rank[piece] < 0:
                return True
            else:
                limit = rank[piece] + 1
                piece = halves[piece][0]
        return True

    def digest(self) -> str:
        return hashlib.sha256(repr((self.kind, self.text, self.score)).encode()).hexdigest()


@functools.lru_cache(maxsize=4)
def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file, read on the driver. BPE models rank their pieces 0, -1, -2, ..."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    what = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "normal"
    pieces = [(m.id_to_piece(i), m.get_score(i), what(i)) for i in range(m.get_piece_size())]
    ranked = [s for _, s, w in pieces if w == "normal"][:1000]
    return Vocabulary(pieces, "bpe" if all(float(s).is_integer() for s in ranked) else "unigram")


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.memo: dict[str, bytes] = {}
        #: By (id of the piece before, or -1, plus one) << 32 | id of the piece: a number takes less memory than the two texts.
        self.fits: dict[int, bool] = {}
        self.raw: dict[str, bytes] = {}
        self.ends: dict[str, tuple[int, ...]] = {}
        self.most_kept = 0

    def _lengths(self, tail: str) -> tuple[int, ...]:
        """The lengths that a piece can have which ends in these (up to three) characters, longest first."""
        if len(self.ends) > MEMO_SIZE:
            self.ends.clear()
        ids = self.v.ids
        got = self.ends[tail] = (self.v.tails.get(tail, ()) if len(tail) == 3 else ()) + tuple(n for n in (2, 1) if len(tail) >= n and tail[-n:] in ids)
        return got

    def _fit(self, key: int, before: int, piece: int) -> bool:
        """Vocabulary.fit(), remembered under `key`."""
        if len(self.fits) >= MEMO_SIZE:
            self.fits.clear()
        got = self.fits[key] = self.v.fit(before, piece)
        return got

    def _ids_of(self, piece: str) -> list[int]:
        i = self.v.ids.get(piece)
        if i is not None:
            return [i]
        raw = [self.v.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return raw if min(raw) >= 0 else [self.v.unknown]

    # The search

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a run of text that comes in chunks, committed as soon as they are certain."""
        for part in (self._bpe if self.v.kind == "bpe" else self._unigram)(chunks):
            yield np.frombuffer(part, np.uint32).tolist()

    def _extend(self, text: str, last: list[str], known: list[int], to: int) -> None:
        """Every position's one valid last piece, for the positions after those of `last` up to `to`."""
        ids, fits, ends = self.v.ids, self.fits, self.ends
        for end in range(len(last), to + 1):
            tail = text[end - 3 if end > 3 else 0 : end]
            lengths = ends.get(tail)
            if lengths is None:
                lengths = self._lengths(tail)
            for n in lengths:
                if n > end:
                    continue
                start = end - n
                piece = text[start:end]
                i = ids.get(piece)
                if i is not None:
                    key = known[start] + 1 << 32 | i
                    fit = fits.get(key)
                    if fit is None:
                        fit = self._fit(key, known[start], i)
                    if fit:
                        last.append(piece)
                        known.append(i)
                        break
            else:
                last.append(text[end - 1])
                known.append(ids.get(text[end - 1], -1))

    def _bpe(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """The valid last pieces in a window that begins at the last committed boundary."""
        longest = self.v.longest
        text, last = "", [""]  # last[i]: the piece that ends at i; last[0]: the one before the window, if there is one
        known = [-1]  # its id; -1: none, or not in the vocabulary
        for chunk in chunks:
            text += chunk
            while (end := len(last) - 1) < len(text):
                end = min(len(text), (end // longest + 1) * longest)
                self._extend(text, last, known, end)
                if end >= 2 * longest and end % longest == 0:
                    meet = self._meeting(last, end, longest)
                    if meet:
                        yield self._path(last, meet)
                        text, last, known, end = text[meet:], last[meet:], known[meet:], end - meet
                self.most_kept = max(self.most_kept, end)
        if len(last) > 1:
            yield self._path(last, len(last) - 1)

    def _learn(self, words: set[str]) -> None:
        """Remember run(w) for words of up to MEMO characters: in order, so that each goes on from where it leaves the one before it."""
        text, last, known = "", [""], [-1]
        for w in sorted(words):
            if self.v.kind != "bpe":
                self.memo[w] = self.run(w)
                continue
            k, most = 0, min(len(w), len(text))
            while k < most and w[k] == text[k]:
                k += 1
            del last[k + 1 :], known[k + 1 :]
            self._extend(w, last, known, len(w))
            self.memo[w] = self._path(last, len(w))
            text = w

    def _unigram(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Every position's best last piece by the sum of scores, in a window that begins at the last committed boundary."""
        ids, scores, longest = self.v.ids, self.v.score, self.v.longest
        text, last, best, end = "", [""], [0.0], 1
        for chunk in chunks:
            text += chunk
            while end <= len(text):
                one = text[end - 1 : end]
                top, piece = (best[end - 1] + self.v.floor, one) if one not in ids else (None, one)
                tail = text[end - 3 if end > 3 else 0 : end]
                for n in self.ends.get(tail) or self._lengths(tail):
                    start = end - n
                    i = ids.get(text[start:end]) if start >= 0 else None
                    if i is not None and (top is None or best[start] + scores[i] > top):
                        top, piece = best[start] + scores[i], text[start:end]
                last.append(piece)
                best.append(top)
                if end >= 2 * longest and end % longest == 0:
                    meet = self._meeting(last, end, longest)
                    if meet:
                        yield self._path(last, meet)
                        text, last, best, end = text[meet:], last[meet:], best[meet:], end - meet
                    self.most_kept = max(self.most_kept, end)
                end += 1
        if end > 1:
            yield self._path(last, end - 1)

    @staticmethod
    def _meeting(last: list[str], end: int, longest: int) -> int:
        """The last boundary on the ways back from all positions of the window; 0 if that is where it begins."""
        at = set(range(end - longest + 1, end + 1))
        while len(at) > 1:
            x = max(at)
            at.discard(x)
            at.add(x - len(last[x]))
        return at.pop()

    def _path(self, last: list[str], at: int) -> bytes:
        out = []
        while at:
            out.append(last[at])
            at -= len(last[at])
        return b"".join([self._raw(p) for p in reversed(out)])

    def run(self, text: str) -> bytes:
        """Ids of a run, as 32-bit numbers, by the streaming search."""
        return b"".join(self._bpe((text,)) if self.v.kind == "bpe" else self._unigram((text,)))

    def _long(self, w: str) -> bytes:
        """Ids of a run of more than MEMO characters: all ways meet where no piece can cross, so it is searched from there to there; short parts are remembered."""
        memo, pairs = self.memo, self.v.pairs
        cuts = [0, *(k for k in range(1, len(w)) if w[k - 1 : k + 1] not in pairs), len(w)]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            p = w[a:b]
            got = memo.get(p)
            if got is None:
                got = self.run(p)
                if len(p) <= MEMO and len(memo) < MEMO_SIZE:
                    memo[p] = got
            out.append(got)
        return b"".join(out)

    def _raw(self, piece: str) -> bytes:
        got = self.raw.get(piece)
        if got is None:
            got = np.array(self._ids_of(piece), np.uint32).tobytes()
            if piece in self.v.ids:
                self.raw[piece] = got
        return got

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The runs "spaces, then others" of a text, in lists of about BLOCK characters."""
        at = 0
        while at < len(text):
            to = at + BLOCK
            if to < len(text):
                while to < len(text) and not (text[to] == " " and text[to - 1] != " "):
                    to += 1
            yield _RUNS.findall(text, at, to)
            at = to

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as 32-bit numbers; null and empty texts have none. Their distinct runs are searched once, together."""
        if not self.v.splits:
            return [self.run(" " + t) if t else b"" for t in texts]
        out = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, t in enumerate(texts):
            for runs in self._runs(" " + t) if t else ():
                held.append((k, runs))
                size += sum(map(len, runs))
                if size >= BLOCK:
                    self._emit(held, out)
                    held, size = [], 0
        self._emit(held, out)
        return [b"".join(x) for x in out]

    def _emit(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        memo = self.memo
        words = {w for _, runs in held for w in runs if len(w) <= MEMO}
        new = words - memo.keys()
        if len(memo) + len(new) > MEMO_SIZE:
            memo.clear()
            new = words
        self._learn(new)
        get, long = memo.get, self._long
        for k, runs in held:
            out[k].append(b"".join([get(w) or long(w) for w in runs]))

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, without the space that encode() put before it."""
        raw = b"".join(map(self.v.text.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder_of(name: str, vocabulary) -> Encoder:
    """The worker's encoder, with the memo of earlier tasks. A module's function, so that it finds the module's own cache after pickling."""
    if name not in _encoders:
        _encoders[name] = Encoder(vocabulary.value)
    return _encoders[name]


def encoded(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, ids (array<int>), n_ids, decoded_sha256 and round_trip.

    decoded_sha256 is of the ids' text in UTF-8, round_trip says whether that is the text (null counts as empty). Repeated rows stay;
    other columns aren't read.
    """
    C.bounded_batches(docs.sparkSession)
    found = load(model)
    vocabulary, name = docs.sparkSession.sparkContext.broadcast(found), found.digest()
    kind = dict(docs.dtypes)[id_col]

    def rows(batches):
        enc = encoder_of(name, vocabulary)
        for b in batches:
            for lo, hi, data, at in B.slices(b.column(1)):
                raw = data.tobytes()
                ids = enc.encode_all([raw[at[k] : at[k + 1]].decode("utf-8", "replace") for k in range(hi - lo)])
                sha, same = [], []
                for k in range(hi - lo):
                    text = raw[at[k] : at[k + 1]]
                    back = enc.decode(np.frombuffer(ids[k], np.uint32).tolist()).encode("utf-8", "surrogatepass")
                    sha.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text)
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                flat = np.frombuffer(b"".join(ids), np.uint32).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists, pa.array(n), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["id", "ids", "n_ids", "decoded_sha256", "round_trip"])

    out = docs.select(C.col(id_col).alias("id"), C.col(text_col).cast("string").alias("text")).mapInArrow(rows, f"id {kind}, ids array<int>, n_ids bigint, decoded_sha256 string, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
