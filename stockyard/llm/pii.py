"""Personal data: plain patterns with checks, and spans that a BiLSTM-CRF adds.

The tagger reads whole texts in windows of LENGTH characters, half overlapping. A character's emissions are the mean of those of all
windows over it, weighted by its distance from their ends, and one Viterbi pass goes over the whole text, so a span may cross windows.
Every span of any kind holds a digit, an @ or a bracket ("[at]"), and its other characters are at most REACH characters from such a
trigger: a hard constraint of the decoder. Where no trigger is so near, all ways are outside; windows that lie there altogether aren't
evaluated, and the pass goes from one such place to the next; a test decodes with all windows and in one piece and gets the same tags.
Added spans must pass their kind's check and mustn't touch a base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import bytetext as B
from stockyard.llm import common as C
from stockyard.llm import tagger

KINDS = tagger.KINDS
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[list(b"0123456789@[(")] = True
_HOT = np.zeros(tagger.CLASSES, bool)
_HOT[[ord(c) - 31 for c in "0123456789@[("]] = True
Span = tuple[int, int, int]  # start, kind, end
REACH = 64


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def is_card(text: str) -> bool:
    d = "".join(_DIGIT.findall(text))
    return 14 <= len(d) <= 19 and luhn(d)


def is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def is_phone(text: str) -> bool:
    return 10 <= len(_DIGIT.findall(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, in time linear in the text."""
    last = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield lo, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts), 4):
            four = parts[k : k + 4]
            end = at + len(".".join(four))
            if is_ip(four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """The plain patterns' spans by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)] + [(s, 1, e) for s, e in _ips(text)]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if is_card(m[0])]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if is_phone(m[0])]
    return sorted(out)


_AT = re.compile(r"@|[\[(] ?at ?[\])]")


def _passes(kind: int, text: str) -> bool:
    if kind == 0:
        head, *tail = _AT.split(text)
        return len(tail) == 1 and bool(head.strip()) and bool(re.fullmatch(r"\s*[A-Za-z0-9-]+(?:(?:\.|\s*[\[(] ?dot ?[\])]\s*)[A-Za-z0-9-]+)+", tail[0]))
    if kind == 1:
        return is_ip(re.findall(r"[0-9]+", text)) and not re.search(r"[A-Za-z0-9]{4}", text)
    if kind == 2:
        return is_card(text) and not re.search(r"[^0-9 ./_-]", text)
    return is_phone(text) and len(_DIGIT.findall(text)) >= 10 and not re.search(r"[^0-9 ().+/-]", text)


def reached(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which characters are within REACH of a trigger of their own text; texts lie end to end, with bounds `at`."""
    hot = np.flatnonzero(_HOT[codes])
    text = np.searchsorted(at, hot, "right") - 1
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, np.maximum(hot - REACH, at[text]), 1)
    np.add.at(change, np.minimum(hot + REACH + 1, at[text + 1]), -1)
    return np.cumsum(change)[:-1] > 0


def windows(codes: np.ndarray, at: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the half-overlapping windows of each text that hold a character of `near`."""
    step, n = tagger.LENGTH // 2, np.diff(at)
    number = np.where(n > 0, np.maximum(1, -(-(n - step) // step)), 0)
    text = np.repeat(np.arange(len(n)), number)
    lo = at[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))
    hi = np.minimum(lo + tagger.LENGTH, at[text + 1])
    seen = np.concatenate([[0], np.cumsum(near)])
    some = seen[hi] > seen[lo]
    return lo[some], hi[some]


class Tagger:
    """Adds spans to texts; `batch` windows are evaluated at a time, whatever the texts' lengths."""

    def __init__(self, weights: dict, batch: int = 1024):
        self.weights, self.batch = weights, batch

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """One tag per character of each text."""
        if not texts:
            return []
        codes = [tagger.classes(t) for t in texts]
        at = np.cumsum([0, *map(len, codes)])
        flat = np.concatenate([np.zeros(0, np.uint8), *codes])
        out = np.zeros(len(flat), np.int8)
        near = reached(flat, at)
        if near.any():
            # Emissions of the characters that may stand in a span, one row each.
            row = np.cumsum(near) - 1
            total, weight = np.zeros((row[-1] + 1, tagger.TAGS), np.float32), np.zeros(row[-1] + 1, np.float32)
            lo, hi = windows(flat, at, near)
            x = np.arange(tagger.LENGTH)
            for parity in (0, 1):  # windows of one parity don't overlap
                for k in range(parity, len(lo), 2 * self.batch):
                    a, b = lo[k : k + 2 * self.batch : 2], hi[k : k + 2 * self.batch : 2]
                    where = a[:, None] + x
                    inside = where < b[:, None]
                    e = tagger.emissions(self.weights, np.where(inside, flat[np.where(inside, where, 0)], 0).astype(np.uint8))[0].transpose(1, 0, 2)
                    tri = np.minimum(x + 1, (b - a)[:, None] - x).astype(np.float32)
                    inside[inside] = near[where[inside]]
                    to = row[where[inside]]
                    np.add.at(total, to, e[inside] * tri[inside][:, None])
                    np.add.at(weight, to, tri[inside])
            edge = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
            cuts = np.unique(np.concatenate([edge, at]))
            starts, ends = cuts[:-1], cuts[1:]
            starts, ends = starts[near[starts]], ends[near[starts]]
            first, last = np.isin(starts, at), np.isin(ends, at)
            tags = tagger.best_paths(self.weights, total / weight[:, None], row[starts], ends - starts, first, last)
            out[near] = tags
        return np.split(out, at[1:-1])

    def added(self, text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
        out: list[Span] = []
        inside = np.flatnonzero(tags)
        if not len(inside):
            return out
        opens = (tags[inside] % 2 == 1) | np.append(True, np.diff(inside) > 1) | np.append(True, (np.diff((tags[inside] + 1) // 2)) != 0)
        first = np.flatnonzero(opens)
        for a, b in zip(first, np.append(first[1:], len(inside)), strict=True):
            s, e, kind = int(inside[a]), int(inside[b - 1]) + 1, (int(tags[inside[a]]) - 1) // 2
            while e > s and text[e - 1] in " \n.,;:!?":
                e -= 1
            while s < e and text[s] in " \n.,;:!?":
                s += 1
            edge = (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())
            if s < e and not edge and _passes(kind, text[s:e]) and not any(x < e and s < z for x, _, z in base):
                out.append((s, kind, e))
        return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    return [(b, sorted(b + model.added(t, g, b))) for t, g, b in zip(texts, model.tags(texts), base, strict=True)]


def spans_of(column: pa.Array, model: Tagger) -> Iterator[tuple[int, int, dict[int, tuple[str, list[Span], list[Span]]]]]:
    """For runs of rows: first, last + 1, and for the rows that have a trigger character: text, base spans, all spans."""
    for lo, hi, data, at in B.slices(column):
        hits = np.unique(np.searchsorted(at, np.flatnonzero(_TRIGGER[data]), "right") - 1)
        raw = data.tobytes()
        texts = [raw[at[k] : at[k + 1]].decode("utf-8", "replace") for k in hits]
        yield lo, hi, {int(k): (t, b, s) for k, t, (b, s) in zip(hits, texts, find(texts, model), strict=True)}


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict | None = None) -> DataFrame:
    """A row for each row of docs: its id, counts of the base spans, base_sha256, spans. Null and empty texts have none; other columns aren't read."""
    C.bounded_batches(docs.sparkSession)
    weights = weights or tagger.trained()
    kind = dict(docs.dtypes)[id_col]
    none = hashlib.sha256(b"").hexdigest()

    def rows(batches):
        model = Tagger(weights)
        for b in batches:
            for lo, hi, found in spans_of(b.column(1), model):
                n = [np.zeros(hi - lo, np.int64) for _ in KINDS]
                sha, spans = [none] * (hi - lo), [""] * (hi - lo)
                for k, (_, base, all_) in found.items():
                    for _, c, _ in base:
                        n[c][k] += 1
                    sha[k], spans[k] = hashlib.sha256(told(base).encode()).hexdigest(), told(all_)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, n), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["id", *(f"n_{c}" for c in KINDS), "base_sha256", "spans"])

    out = docs.select(C.col(id_col).alias("id"), C.col(text_col).cast("string").alias("text")).mapInArrow(rows, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """Every span (overlapping ones together) replaced by its kind in angle brackets."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", weights: dict | None = None) -> DataFrame:
    """docs with all personal data masked in text (n_chars, if there is one, set anew); all rows and columns stay, a null text stays null."""
    C.bounded_batches(docs.sparkSession)
    weights = weights or tagger.trained()
    where = docs.columns.index(text_col)

    def rows(batches):
        model = Tagger(weights)
        for b in batches:
            for lo, hi, found in spans_of(b.column(where), model):
                part = b.slice(lo, hi - lo)
                if found:
                    texts = part.column(where).to_pylist()
                    for k, (t, _, spans) in found.items():
                        if spans:
                            texts[k] = masked(t, spans)
                    part = part.set_column(where, b.schema.field(where).name, pa.array(texts, b.schema.field(where).type))
                yield part

    # Under plain names, since a column's own may hold anything.
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    out = plain.mapInArrow(rows, plain.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length(C.col(text_col)).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_pii": op9_pii}
ORACLE_SQL: dict[str, str] = {}
