"""Secrets in texts: plain patterns, and strings in sensitive places that a primed compressor finds new.

A candidate is a run of token characters of SHORTEST or more that holds a dense piece: one that changes between small letters, capitals and
digits more often than joined words and numbers do. Its place is sensitive if a word of SENSITIVE stands shortly before it on its line, if it is the
password of a URL, if it starts like a key of a known service, or if only white space parts it from a span that was added (the next line of a key block).

Its novelty is the number of bytes that zstandard takes for it more than for nothing, primed with a dictionary of identifiers and the
WINDOW characters of text on either side (other places of the candidate itself taken out). Names, paths and repeated text are found in the
dictionary and cost a few bytes; a random string costs nearly its length. Reported are candidates whose novelty is at least NOVEL of their length
and LEAST bytes.

The dictionary holds the identifiers (words joined by underscores or by capitals, or called as functions) of the most rows of the whole
corpus, DICTIONARY of them; rows that hold an identifier are counted once each. Identifiers have no digits and pieces of three letters
on average, so that no key gets into it by being copied often. Python's own words are in it always.

Nulls and empty texts have no spans. Repeated rows are documents of their own and get the same spans; each row of docs gives one row. Only the
two named columns are read, so others can't clash. Texts are read whole; a task holds one Arrow batch of them and some 1 MB besides.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import bytetext as B
from stockyard.llm import common as C

KINDS = ("assign", "access", "hex", "novel")
Span = tuple[int, int, int]  # start, kind, end
SHORTEST, WINDOW, NOVEL, LEAST, DICTIONARY = 10, 1024, 0.5, 8, 2000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, since what is shorter fails and nothing is tried again
#: Places, in lower case, up to the candidate.
SENSITIVE = re.compile(
    r"(?:pass(?:word|wd|phrase|code)|secret|token|credential|bearer|authorization|api[ _-]?key|(?:access|private|signing|encryption|master|session|account|shared|storage)[ _-]?key"
    r"|(?<![a-z])(?:pwd|pass|auth|key|cookie|sessionid|webhook|connection string)(?![a-z]))[^\n]{0,24}$",
    re.ASCII,
)
_URL_PASSWORD = re.compile(r"://[^\s/:@]*:$")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*KEY-----\s*$")
#: How keys of known services start.
SERVICES = re.compile(r"gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k_live_|[sr]k_test_|sk-|AIza|ya29\.|eyJ|npm_|hf_|SG\.|dop_v1_|shpat_|ASIA")
_RUN = re.compile(rf"[A-Za-z0-9+/_.=~-]{{{SHORTEST},}}")
_PIECE = re.compile(r"[A-Za-z0-9+]{6,}")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CHANGES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|\+")
_HOST = re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,6}(?:/[\w./-]*)?")
#: Words that must be in a row (in lower case) for it to hold an assign span, an access span, a sensitive place.
_ASSIGNED = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_PLACES = (b"pass", b"pwd", b"secret", b"token", b"credential", b"bearer", b"auth", b"key", b"cookie", b"sessionid", b"webhook", b"connection string", b"://")
_SERVED = (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"github_pat_", b"glpat-", b"xox", b"k_live_", b"k_test_", b"sk-", b"AIza", b"ya29.", b"eyJ", b"npm_", b"hf_", b"SG.", b"dop_v1_", b"shpat_", b"ASIA", b"AKIA")
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=~-")] = True
_HEXES = np.zeros(256, bool)
_HEXES[list(b"0123456789abcdef")] = True
#: An identifier: words joined by underscores or capitals, or a word before a bracket. As Java's regular expressions have it.
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:[A-Za-z]++(?:_[A-Za-z]++){1,12}+|[a-z]++(?:[A-Z][a-z]++){1,12}+|[A-Za-z]{3,40}+(?=\())(?![A-Za-z0-9_])"


def is_plain(identifier: str) -> bool:
    """Whether its pieces are words by their length: three letters on average, none over 20."""
    w = _WORDS.findall(identifier)
    return bool(w) and sum(map(len, w)) >= 3 * len(w) and max(map(len, w)) <= 20


def identifiers(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> list[str]:
    """The identifiers of the most rows, the commonest last (the compressor reaches those most cheaply); equal counts go by name. At most `most` names come to the driver."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(C.col(text_col).cast("string"), F.lit(IDENTIFIER), 0))).alias("w")
    counts = docs.where(C.col(text_col).cast("string").rlike(r"[A-Za-z](?:_[A-Za-z]|\(|[A-Z])")).select(word).where(F.length("w") <= 64).groupBy("w").count()
    letters = F.length(F.regexp_replace("w", "_", ""))
    words = F.greatest(F.lit(1), F.regexp_count("w", F.lit(_WORDS.pattern)))
    best = counts.where((F.col("count") > 1) & (letters >= 3 * words)).orderBy(F.desc("count"), "w").limit(most).collect()
    return [r["w"] for r in reversed(best) if is_plain(r["w"])]


def dictionary(names: list[str]) -> bytes:
    own = sorted(set(keyword.kwlist) | {n for n in dir(builtins) if not n.startswith("_")})
    return "\n".join([*own, *names, ""]).encode()


def _runs(mask: np.ndarray, at: np.ndarray, shortest: int) -> np.ndarray:
    """The rows that have a run of `shortest` bytes of mask; a row's start ends the run before it."""
    first = np.zeros(len(mask) + 1, bool)
    first[at] = True
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1] | first[1:-1]
    closes[:-1] &= ~mask[1:] | first[1:-1]
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return _rows(lo[hi - lo >= shortest], at)


def _rows(places, at: np.ndarray) -> np.ndarray:
    return np.unique(np.searchsorted(at, np.asarray(places, np.int64), "right") - 1)


def _places(raw: bytes, words: tuple[bytes, ...]) -> list[int]:
    out = []
    for w in words:
        at = raw.find(w)
        while at >= 0:
            out.append(at)
            at = raw.find(w, at + len(w))
    return out


def rows_to_read(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a slice that can hold a span: in the others no pattern and no place matches."""
    if not len(data):
        return np.zeros(0, np.int64)
    low, raw = B.LOWER[data].tobytes(), data.tobytes()
    some = np.intersect1d(_runs(_TOKEN[data], at, SHORTEST), _rows(_places(low, _PLACES) + _places(raw, _SERVED), at))
    return np.unique(np.concatenate([_runs(_HEXES[data], at, 24), _rows(_places(low, _ASSIGNED) + _places(raw, (b"AKIA",)), at), some]))


def base_spans(text: str) -> list[Span]:
    """The plain patterns' spans by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def is_dense(run: str) -> bool:
    """Whether a piece of it changes between small letters, capitals and digits more often than words and numbers do: every three characters on average."""
    if _HOST.fullmatch(run) or "://" in run:
        return False
    return any(len(p) < 3 * len(_CHANGES.findall(p)) and not p.isdigit() and (len(p) >= 8 or len(run) >= 16) for p in _PIECE.findall(run))


class Novelty:
    """Measures strings against text around them."""

    def __init__(self, names: list[str]):
        self.known = dictionary(names)

    def of(self, text: str, start: int, end: int) -> int:
        """The marginal bytes of text[start:end]."""
        own = text[start:end]
        around = (text[max(0, start - WINDOW) : start] + "\n" + text[end : end + WINDOW]).replace(own, "\n")
        primed = zstandard.ZstdCompressionDict(self.known + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        pack = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        return len(pack(own.encode("utf-8", "replace"))) - len(pack(b""))


def added_spans(text: str, base: list[Span], novelty: Novelty) -> list[Span]:
    """The candidates in sensitive places that are new, none touching a base span."""
    out: list[Span] = []
    taken = iter([*base, (len(text) + 1, 0, len(text) + 1)])
    lo, _, hi = next(taken)
    for m in _RUN.finditer(text):
        own = m[0].rstrip(".-_/~")
        s = m.start() + len(own) - len(own := own.lstrip(".=/~"))
        before = text[max(0, s - 80) : s]
        # NAME=value is one run; the name is a part of the place.
        if (cut := own.rstrip("=").rfind("=")) >= 0:
            before, own, s = before + own[: cut + 1], own[cut + 1 :], s + cut + 1
        e = s + len(own)
        if len(own) < SHORTEST or not is_dense(own):
            continue
        while hi <= s and lo <= len(text):
            lo, _, hi = next(taken)
        if lo < e:
            continue
        follows = out and not text[out[-1][2] : s].strip() and s - out[-1][2] <= 80
        served = SERVICES.match(own)
        place = follows or served or _KEY_BLOCK.search(before) or SENSITIVE.search(before.lower()) or (_URL_PASSWORD.search(before) and text[e : e + 1] == "@")
        if place and (new := novelty.of(text, s, e)) >= LEAST and new >= NOVEL * len(own):
            out.append((s, 3, e))
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: its id, counts of the base spans, base_sha256, spans. names: the dictionary's identifiers, from docs if not given."""
    C.bounded_batches(docs.sparkSession)
    docs = docs.select(C.col(id_col).alias("id"), C.col(text_col).cast("string").alias("text"))
    names = identifiers(docs) if names is None else names
    kind = dict(docs.dtypes)["id"]
    none = hashlib.sha256(b"").hexdigest()

    def rows(batches) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(names)
        for b in batches:
            for lo, hi, data, at in B.slices(b.column(1)):
                n = [np.zeros(hi - lo, np.int64) for _ in KINDS[:3]]
                sha, spans = [none] * (hi - lo), [""] * (hi - lo)
                for k in rows_to_read(data, at).tolist():
                    text = data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")
                    base = base_spans(text)
                    for _, c, _ in base:
                        n[c][k] += 1
                    sha[k], spans[k] = hashlib.sha256(told(base).encode()).hexdigest(), told(base + added_spans(text, base, novelty))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, n), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["id", *(f"n_{c}" for c in KINDS[:3]), "base_sha256", "spans"])

    out = docs.mapInArrow(rows, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(C.table(spark, sf_dir, "documents"))


QUERIES = {"op13_secrets": op13_secrets}
ORACLE_SQL: dict[str, str] = {}
