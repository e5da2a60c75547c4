"""URL filter: longest matching host/path rule, else logistic regression on hashed character n-grams.

Native: JVM expressions and the DataFrame-based ML pipeline only. Nulls, empty urls and urls without :// have an empty host and path and
are judged as such; repeated rows and equal ids are rows of their own; of rules of one length the greater in order wins; an empty table
gives an empty result. Only url and the columns asked for are read.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import common as C

#: (rule, verdict); the host is what stands before the first slash.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

#: Words of names, from general knowledge of what sites are called; no table of pages was looked at.
GOOD_WORDS = "garden history museum library weather recipe school science travel football chess poetry railway harbour village teaching reading newspaper forest medicine law research physics music painting bakery bridge castle dance energy farm gallery hospital island journal kitchen language market nature opera parish quality river sailing theatre university valley water yoga zoology".split()
BAD_WORDS = "casino poker roulette jackpot slots gambling betting bets viagra cialis pills pharma-deal porn xxx sex adult escort camgirls nude spam phishing malware warez crack keygen torrent clickbait adserver ads banner popup tracker payday loan free-money cheap win prize lottery miracle-cure".split()
_SYLLABLES = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
_PLACES = ("com", "org", "net", "de", "co.uk", "info")
_PREFIXES = ("", "www.", "m.", "blog.")
_PATHS = ("/", "/en/12", "/fr/825", "/de/481/", "/es/7.html", "/about/team", "/2020/05/story")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (host, path, label), by rule: names of one word, of two words of the same list, and good names of no word.

    A bad name has a word of the bad list or two; good names of no word are syllables in a fixed order, so that strange letters alone
    aren't bad. Places, prefixes and paths go round both labels alike.
    """
    rows = []
    for words, label in ((GOOD_WORDS, 0.0), (BAD_WORDS, 1.0)):
        n = len(words)
        names = words + [f"{w}{'-' if k % 2 else ''}{words[(7 * k + 3) % n]}" for k, w in enumerate(words)]
        names += [f"{w}-{x}" for w, x in zip(BAD_WORDS, GOOD_WORDS, strict=False)] if label else ["".join(_SYLLABLES[(11 * k + 17 * j * j) % len(_SYLLABLES)] for j in range(2 + k % 3)) for k in range(2 * n)]
        rows += [(f"{_PREFIXES[(k + j) % 4]}{name}.{place}", _PATHS[(3 * k + j) % 7], label) for k, name in enumerate(names) for j, place in enumerate(_PLACES) if (k + j) % 3 == 0]
    return spark.createDataFrame(rows, "host string, path string, label double")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. A rule fits its host and all subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _stages(buckets: int, least: int, most: int) -> list:
    """Hashed character n-grams, host and path in feature spaces of their own."""
    out, vectors = [], []
    for field in ("_host", "_path"):
        out.append(RegexTokenizer(inputCol=field, outputCol=f"{field}_c", pattern=r"(?s).", gaps=False, toLowercase=True))
        for n in range(least, most + 1):
            out += [NGram(n=n, inputCol=f"{field}_c", outputCol=f"{field}_{n}"), HashingTF(inputCol=f"{field}_{n}", outputCol=f"{field}_v{n}", numFeatures=buckets, binary=True)]
            vectors.append(f"{field}_v{n}")
    return [*out, VectorAssembler(inputCols=vectors, outputCol="_features")]


def _marked(df: DataFrame) -> DataFrame:
    """With ^ and $ around the host and ^ before the path, so that n-grams know the ends; an empty field has its marks only."""
    return df.withColumns({"_host": F.concat(F.lit("^^"), "host", F.lit("$$")), "_path": F.concat(F.lit("^^"), "path", F.lit("$$"))})


def train(labelled: DataFrame, buckets: int = 4096, least: int = 3, most: int = 4, reg: float = 0.01) -> PipelineModel:
    """Fit on labelled (host, path, label); rows with a null in any of them are left out."""
    df = _marked(labelled.select("host", "path", "label").dropna())
    lr = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred", regParam=reg, maxIter=50)
    return Pipeline(stages=[*_stages(buckets, least, most), lr]).fit(df)


def filter_urls(pages: DataFrame, model: PipelineModel, rules=RULES, threshold: float = 0.5, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, verdict, bad_probability for every row of pages (url).

    A rule's verdict stands; else block from a probability of threshold on. Nulls, empty urls and repeated rows stay as rows of their own;
    other columns of pages are not looked at, so their names can't clash.
    """
    df = pages.select(*[C.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = model.transform(_marked(df)).withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("p", vector_to_array("_p")[1])
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("p") >= threshold, "block").otherwise("allow"))
    return df.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.col("p").alias("bad_probability"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, train(labelled_urls(spark)))


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE_SQL: dict[str, str] = {}
