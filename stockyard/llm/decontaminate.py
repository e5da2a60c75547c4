"""Benchmark decontamination by templates, with DataFrame and SQL functions only.

A text becomes canonical tokens: words in lower case without outer punctuation, with numbers, units after numbers and names (capitalised
words, wherever they stand) replaced by typed placeholders; names with nothing but a space between are one, so "Anna" meets "Mary Ann". Every window of
`window` canonical tokens of the documents is hash-joined with the benchmark's windows that hold a word. Hits of a document and an item
are one alignment if they lie on one diagonal (document position less item position), or on several within a band of BAND shifts (words
put in or left out). An alignment is a leak if its windows cover `share` of the item's tokens, and if its slots are consistent: what an
item puts in a slot always meets one and the same value in the document, and two names of an item never meet one name (two numbers may,
by chance). So the same question with other names and numbers is caught, and a chance match of placeholders is not.

Whether a text leaks follows from the text alone, so texts are called by their MD5: a row with a null id is judged by its own text, and
all rows of an id that leaks are meant. Null and empty texts have no windows; an item or document shorter than a window is one window of its own length, so only an
equal text meets it; an item of placeholders only has none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockyard.llm import common as C

WINDOW, SHARE, BAND = 6, 0.5, 16
#: Item positions on either side that a chain's mean shift is taken over.
REACH = 20
_NAME = "\u0001n"
#: Units that become a placeholder after a number.
UNITS = "kg g mg km m cm mm mi mile miles ft feet inch inches l ml s sec secs second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents pound pounds".split()
SPACE = r"[\x20\x09-\x0D]+"
_NUMBER = r"(?<![\p{L}\p{N}])[-+$€£]?\p{N}+(?:[.,:/]\p{N}+)*"


def _unmarked(text: Column) -> Column:
    """Without the control characters that mark placeholders here; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002\u0003", "")


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(_unmarked(text), SPACE), lambda t: t != "")


def canonical(text: Column) -> Column:
    """The canonical text before runs of names are one: as many tokens as raw_tokens(text), one space between them."""
    t = F.regexp_replace(F.concat(F.lit(" "), _unmarked(text), F.lit(" ")), SPACE, " ")
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<![\p{L}\p{N}])\p{Lu}\p{Ll}[\p{L}'’-]*", _NAME)
    t = F.regexp_replace(t, rf"(?<= )\p{{P}}*{_NUMBER}(%|(?:[\p{{L}}°]*))(?= |\p{{P}})", "\u0001d$1")
    t = F.regexp_replace(t, rf"(?<=\u0001d )(?:{'|'.join(UNITS)})(?= |\p{{P}})", "\u0001u")
    return F.trim(F.lower(t))


def _bare(tokens: Column) -> Column:
    """Tokens without outer punctuation; what is only punctuation stays."""
    return F.transform(tokens, lambda w: F.coalesce(F.nullif(F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""), F.lit("")), w))


def canonical_tokens(text: Column, fold: bool = True) -> Column:
    c = canonical(text)
    if fold:
        c = F.regexp_replace(c, rf"(?<={_NAME}) {_NAME}", "")
    # One pass over the text drops punctuation at token ends, far cheaper than one per token; a token of nothing else keeps its first sign.
    # Whether a sign stands here is asked first, since that fails at most places.
    c = F.regexp_replace(c, r"(?=[\p{P}\p{S}])(?:(?<=[\p{L}\p{N}])[\p{P}\p{S}]+(?= |$)|(?<= |^)[\p{P}\p{S}]+(?=[\p{L}\p{N}\u0001]))", "")
    return F.filter(F.split(c, " "), lambda t: t != "")


def slot_tokens(text: Column) -> Column:
    """The raw tokens that stand beside canonical_tokens(text), without outer punctuation; a run of names is one of them."""
    mark = lambda c, r: F.concat(F.when(c.startswith(_NAME), "\u0001").otherwise(""), r, F.when(c.endswith(_NAME), "\u0003").otherwise(""))
    marked = F.array_join(F.zip_with(F.filter(F.split(canonical(text), " "), lambda t: t != ""), _bare(raw_tokens(text)), mark), " ")
    return F.filter(F.split(F.translate(F.regexp_replace(marked, "\u0003 \u0001", "\u0002"), "\u0001\u0003", ""), " "), lambda t: t != "")


def _texts(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """(key, text): a text called by its MD5; no nulls."""
    text = C.col(text_col).cast("string")
    return df.select(F.md5(text.cast("binary")).alias(key), text.alias("_text")).filter("_text IS NOT NULL")


def windows(texts: DataFrame, window: int, prefix: str, words_only: bool = False) -> DataFrame:
    """A row for each window of (`{prefix}_id`, _text): {prefix}_id, {prefix}_n (tokens of the text), {prefix}_pos, hash."""
    d = texts.select(f"{prefix}_id", canonical_tokens(F.col("_text")).alias("_t"))
    d = d.withColumn(f"{prefix}_n", F.size("_t")).filter(F.col(f"{prefix}_n") > 0)
    if words_only:
        d = d.withColumn("_word", F.transform("_t", lambda t: ~t.startswith("\u0001")))
    hashes = F.transform("_t", lambda t: F.xxhash64(t))
    d = d.select(f"{prefix}_id", f"{prefix}_n", hashes.alias("_h"), *(["_word"] if words_only else []))
    slots = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(f"{prefix}_n") - window))
    each = F.transform(slots, lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(window)]))
    # One row of one array first: then what takes it apart reads a plain column and is compiled together with the join that follows.
    d = d.select(f"{prefix}_id", f"{prefix}_n", *(["_word"] if words_only else []), F.explode(F.array(each)).alias("_each"))
    out = d.select(f"{prefix}_id", f"{prefix}_n", *(["_word"] if words_only else []), F.posexplode("_each").alias(f"{prefix}_pos", "hash"))
    return out.filter(F.array_contains(F.slice("_word", F.col(f"{prefix}_pos") + 1, window), True)).drop("_word") if words_only else out


def _chains(hits: DataFrame, band: int) -> DataFrame:
    """(d_id, i_id, i_n, hit, w): hits of diagonals that follow one another within `band` shifts, one hit for each item position."""
    by = ["d_id", "i_id", "i_n"]
    lines = hits.groupBy(*by, "shift").agg(F.count("*").alias("n"))  # a diagonal is one row, however many hits lie on it
    along = Window.partitionBy(*by).orderBy("shift")
    lines = lines.withColumn("new", F.coalesce((F.col("shift") - F.lag("shift").over(along) > band).cast("int"), F.lit(0))).withColumn("at", F.sum("new").over(along).cast("int"))
    # Chains that reach beyond a band; the bands have the others.
    wide = lines.withColumn("span", F.max("shift").over(Window.partitionBy(*by, "at")) - F.min("shift").over(Window.partitionBy(*by, "at"))).where(F.col("span") >= band // 2)
    mine = hits.join(wide.select(*by, "shift", "at"), [*by, "shift"])
    near = F.avg("shift").over(Window.partitionBy(*by, "at").orderBy("i_pos").rangeBetween(-REACH, REACH))
    one = mine.withColumn("off", F.abs(F.col("shift") - near)).groupBy(*by, "at", "i_pos").agg(F.min_by("shift", F.struct("off", "shift")).alias("shift"))
    return one.select(*by, F.struct("i_pos", "shift").alias("hit"), F.struct(F.lit(3).alias("way"), "at").alias("w"))


def alignments(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE, band: int = BAND) -> DataFrame:
    """(d_id, i_id, i_n, hits, covered) of (d_id, _text) and (i_id, _text): diagonals, bands and chains whose windows cover `share` of the item's tokens."""
    bench = C.small_or_not(C.written(windows(items, window, "i", True), "bench-windows")[0])
    # Read three times below, and far smaller than the texts' windows.
    hits, _ = C.written(windows(docs, window, "d").join(bench, "hash").select("d_id", "i_id", "i_n", "i_pos", (F.col("d_pos") - F.col("i_pos")).alias("shift")), "bench-hits")
    # Two bands for each shift, so that any two shifts less than half a band apart share one. A band holds at most BAND hits for a token of the item.
    ways = F.array(*[F.struct(F.lit(k).alias("way"), at.alias("at")) for k, at in enumerate((F.col("shift"), F.floor(F.col("shift") / band).cast("int"), F.floor((F.col("shift") + band // 2) / band).cast("int")))])
    each = hits.select("d_id", "i_id", "i_n", F.struct("i_pos", "shift").alias("hit"), F.explode(ways).alias("w"))
    found = each.unionByName(_chains(hits, band)).groupBy("d_id", "i_id", "i_n", "w").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    found = found.filter((F.col("w.way") == 0) | F.exists("hits", lambda h: h["shift"] != F.get(F.col("hits"), F.lit(0))["shift"]))
    # Tokens covered: each window adds those past the end of the window before it.
    one = F.least(F.lit(window), F.col("i_n"))
    gaps = F.transform("hits", lambda h, k: F.least(one, F.when(k == 0, one).otherwise(h["i_pos"] - F.get(F.col("hits"), k - 1)["i_pos"])))
    found = found.withColumn("covered", F.aggregate(gaps, F.lit(0), lambda s, x: s + x))
    return found.filter(F.col("covered") >= F.ceil(share * F.col("i_n"))).select("d_id", "i_id", "i_n", "hits", "covered")


def _leaking(docs: DataFrame, items: DataFrame, text_col: str, window: int, share: float) -> DataFrame:
    """(d_id, i_id, b): texts that leak, with the best alignment's covered, exact, i_n and n_slots, as a table."""
    d, i = _texts(docs, text_col, "d_id"), _texts(items, "text", "i_id").distinct()
    found, path = C.written(alignments(d, i, window, share), "alignments")
    ids, ids_path = C.written(found.select("d_id").distinct(), "aligned-texts")
    d = d.join(C.small_or_not(ids), "d_id", "left_semi").dropDuplicates(["d_id"]).select("d_id", canonical_tokens(F.col("_text")).alias("_dc"), slot_tokens(F.col("_text")).alias("_dr"))
    i = i.select("i_id", canonical_tokens(F.col("_text")).alias("_ic"), slot_tokens(F.col("_text")).alias("_ir"))
    both = found.join(d, "d_id").join(i, "i_id")
    names = ("ic", "ir", "dc", "dr")

    def beside(h):
        return F.arrays_zip(*[F.slice(f"_{c}", (h["i_pos"] if c[0] == "i" else h["i_pos"] + h["shift"]) + 1, window).alias(c) for c in names])

    slots = F.filter(F.flatten(F.transform("hits", beside)), lambda z: z["ic"].startswith("\u0001") & (z["ic"] == z["dc"]))
    pairs = F.array_distinct(F.transform(slots, lambda z: F.struct(z["ic"].alias("kind"), F.lower(z["ir"]).alias("i"), F.lower(z["dr"]).alias("d"))))
    both = both.select("d_id", "i_id", "i_n", "covered", pairs.alias("pairs"))
    of = lambda side, some=None: F.size(F.array_distinct(F.transform(F.filter("pairs", some) if some else F.col("pairs"), lambda p: F.struct(p["kind"], p[side]))))
    named = lambda p: p["kind"] == _NAME
    one_way, back = F.size("pairs") == of("i"), F.size(F.filter("pairs", named)) == of("d", named)
    checked = both.filter(one_way & back).select("d_id", "i_id", "i_n", "covered", F.size("pairs").alias("n_slots"), F.forall("pairs", lambda p: p["i"] == p["d"]).alias("exact"))
    out, _ = C.written(checked.groupBy("d_id", "i_id").agg(F.max(F.struct("covered", "exact", "i_n", "n_slots")).alias("b")), "leaking-texts")
    for p in (path, ids_path):
        C.drop_path(docs.sparkSession, p)
    return out


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, n_item_tokens, n_slots, exact): each leak once, its best alignment; exact if all slots keep their values.

    n_slots counts pairs of an item's and a document's value. A null doc_id or item_id is an id like any other.
    """
    found = C.small_or_not(_leaking(docs, items, text_col, window, share))
    d = docs.select(C.col(id_col).alias("doc_id"), F.md5(C.col(text_col).cast("string").cast("binary")).alias("d_id"))
    i = items.select("item_id", F.md5(F.col("text").cast("string").cast("binary")).alias("i_id"))
    best = d.join(found, "d_id").join(i, "i_id").groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "item_id", *[F.col(f"b.{c}").cast("bigint").alias(n) for c, n in (("covered", "covered"), ("i_n", "n_item_tokens"), ("n_slots", "n_slots"))], F.col("b.exact").alias("exact"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has no leak, nor that of another row with their (not null) id; all columns of docs."""
    texts, _ = C.written(_leaking(docs, items, text_col, window, share).select(F.col("d_id").alias("leaking")).distinct(), "leaking")
    texts = C.small_or_not(texts)
    # The whole row under one name, so that no column of docs can clash.
    rows = docs.select(F.struct(*[C.col(c) for c in docs.columns]).alias("row"), F.md5(C.col(text_col).cast("string").cast("binary")).alias("key"), C.col(id_col).alias("id"))
    ids, _ = C.written(rows.join(texts, F.col("key") == F.col("leaking"), "left_semi").select(F.col("id").alias("leaking")).distinct(), "leaking-ids")
    kept = rows.join(texts, F.col("key") == F.col("leaking"), "left_anti").join(C.small_or_not(ids), F.col("id") == F.col("leaking"), "left_anti")
    return kept.select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL: dict[str, str] = {}
