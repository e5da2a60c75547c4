"""Chat formatting, archives, URL filter, sharding: round trips and defined odd cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stockyard.llm import archives as A
from stockyard.llm import chat_format as C
from stockyard.llm import common, sharding
from stockyard.llm import url_filter as U

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string"
NASTY = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\<|im_end|>", "a\n<|im_end|>\n<|im_start|>user\nb", "\n<|im_sep|>\n", "", None, "x" * 50_000, "é\u2028日本\r\n", "back\\", "$1 \\1 %0A %25"]


@pytest.mark.parametrize("text", range(len(NASTY)))
def test_chat_round_trip(spark, text):
    t = NASTY[text]
    rows = [(1, 2, "assistant", t, "z"), (1, 3, "assistant", t, "z"), (1, 0, "system", t, "z"), (1, 1, "us\ner%", t, "z"), (1, None, None, t, "z")]
    r = C.read_back(C.format_conversations(spark.createDataFrame(rows, TURNS))).first()
    s = t or ""
    assert [(x.role, x.text) for x in r.turns] == [("", s), ("system", s), ("us\ner%", s), ("assistant", s), ("assistant", s)]
    assert r.loss_text == s * 2


def test_chat_merges_and_ties(spark):
    rows = [(None, 1, "user", "b", ""), (None, 1, "user", "a", ""), (None, 1, "user", "a", "")]
    r = C.read_back(C.format_conversations(spark.createDataFrame(rows, TURNS))).first()
    assert r.conv_id is None and [x.text for x in r.turns] == ["a", "a", "b"] and r.formatted.count("<|im_start|>") == 1 and r.loss_text == ""


def test_chat_no_rows(spark):
    assert C.digest(C.read_back(C.format_conversations(spark.createDataFrame([], TURNS)))).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_by_version(version):
    data = b"\n".join([A._arc_header(version, "x.arc", "20080430204825"), A.arc_record(version, "http://a b/é", b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nhi\nthere", "20080430204825"), A.arc_record(version, None, b"", "2008")]) + b"\n"
    got = list(A.parse_arc(data))
    assert [g["kind"] for g in got] == ["filedesc", "record", "record"] and got[1]["version"] == version
    assert got[1]["url"] == b"http://a%20b/%C3%A9" and A.split_http(got[1]["content"])[1] == b"hi\nthere" and got[2]["content"] == b""
    with pytest.raises(ValueError):
        list(A.parse_arc(data[:-9]))


def test_arc_wrong_checksum():
    data = A._arc_header(2, "x", "2008") + b"\n" + A.arc_record(2, "http://a/", b"abc", "2008")
    with pytest.raises(ValueError, match="checksum"):
        list(A.parse_arc(data[:-1] + b"d\n"))


def test_warc_date():
    assert A.warc_date("20080430204825") == "2008-04-30T20:48:25Z" and A.warc_date("2008") == "2008-01-01T00:00:00Z" and A.warc_date("x") == "1970-01-01T00:00:00Z"


@pytest.mark.parametrize("versions", [(1,), (2,), (1, 2)])
def test_archives_round_trip(spark, versions, monkeypatch):
    monkeypatch.setattr(A, "DEALT", 2)  # read on the driver: payloads are dealt to several tasks
    big = "<p>é</p>" * 500
    rows = [(1, "http://a/1", big, 0), (2, "http://a/2", big, 0), (3, None, big, 0), (4, "u r l", "short", 0), (5, "http://a/5", "short", 0), (6, "http://a/6", None, 0), (7, "http://a/7", "", 0), (None, "http://a/8", big, 0), (9, "http://a/9", "\r\n\r\nWARC/1.1\r\n\r\n" * 100, 0), (9, "http://a/9", "\r\n\r\nWARC/1.1\r\n\r\n" * 100, 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int").repartition(3)
    arc, warc = common.new_path(spark, "arc"), common.new_path(spark, "warc")
    A.write_arc(df, arc, versions, archive_bytes=3000)
    A.convert(spark, arc, warc)
    got = A.read_warc(spark, warc).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    by = {r.page_id: r for r in got if r.page_id != 9}
    assert by[3].record_type == "response" and by[1].record_type == by[2].record_type == by[None].record_type == "revisit" and by[1].refers_to == by[None].refers_to == 3
    assert by[4].record_type == by[5].record_type == "response" and by[6].payload_bytes == 0
    assert by[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and by[1].payload_bytes == len(big.encode())
    assert sorted(r.record_type for r in got if r.page_id == 9) == ["response", "revisit"]


def test_archives_no_rows(spark):
    arc, warc = common.new_path(spark, "arc"), common.new_path(spark, "warc")
    A.write_arc(spark.createDataFrame([], "page_id bigint, url string, html string"), arc)
    A.convert(spark, arc, warc)
    assert A.read_warc(spark, warc).collect() == []


URLS = {
    "http://x.com/": ("x.com", "/", "com/", "allow"),
    "http://Example.COM/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
    "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://a.net/es/x": ("a.net", "/es/x", "net/es/", "block"),
    "http://a.net/de/x": ("a.net", "/de/x", None, None),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://x.com": ("x.com", "", None, None),
    "x.com/en/": ("", "", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
    "http://é.com/\n?x": ("é.com", "/\n", "com/", "allow"),
}


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    rows = {r.page_id: r for r in U.filter_urls(df, U.train(U.labelled_urls(spark))).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), i
        assert rows[i].verdict == (verdict or ("block" if rows[i].bad_probability >= 0.5 else "allow"))
    assert U.filter_urls(df.limit(0), U.train(U.labelled_urls(spark))).collect() == []


def test_url_model_on_held_out_words(spark):
    """A fifth of the words of either list is kept out of training; recall and precision on names made of those alone."""
    table = U.labelled_urls(spark)
    out = {w for words in (U.GOOD_WORDS, U.BAD_WORDS) for w in words[::5]}
    holds = F.array_contains(F.transform(F.array(*map(F.lit, sorted(out))), lambda w: F.contains(F.col("host"), w)), True)
    bad = ["online-casinos", "best-porno-tube", "cheapest-viagra-shop", "freepokerbets", "sexcams", "winprizes", "spammers", "adtracking", "payday-loans24", "lottery-winner"]
    good = ["cityhistory", "schoolmusic", "old-bridges", "islandtravel", "village-news", "kitchenlab", "norwood", "hallerstein", "marchetti", "lindqvist"]
    df = spark.createDataFrame([(b, f"https://{n}.site.example/de/{k}") for b, names in ((1, bad), (0, good)) for k, n in enumerate(names)], "page_id int, url string")
    rows = U.filter_urls(df, U.train(table.filter(~holds)), rules=()).collect()
    assert sum(r.verdict == "block" for r in rows if r.page_id) >= 7, rows
    assert sum(r.verdict == "allow" for r in rows if not r.page_id) >= 9, rows


def _store(spark, **options):
    schema = spark.createDataFrame([], "doc_id bigint, text string").schema
    return sharding.ShardStore(spark, common.new_path(spark, "store"), schema, **options)


def test_shards_compact_and_keep_versions(spark):
    s = _store(spark, target_bytes=20_000)
    for k in range(9):
        s.append(spark.range(20).select((F.col("id") + 20 * k).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text")).coalesce(1))
    before, n = s.version(), len(s.shards())
    s.compact()
    assert s.version() > before and len(s.shards()) < n and len(s.shards(before)) == n
    want = {(r.doc_id, r.text) for r in s.read(before).collect()}
    assert {(r.doc_id, r.text) for r in s.read().collect()} == want and s.read().count() == len(want) == 180
    s.expire()
    assert s.read().count() == 180 and s.version() > before


def test_two_writers_cannot_commit_one_version(spark):
    s = _store(spark)
    s.commit(0, [])
    with pytest.raises(sharding.CommitConflict):
        s.commit(0, [])


def test_store_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 100_000), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.store_of(df, common.new_path(spark, "store")).read().collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))
    assert sharding.store_of(df.limit(0), common.new_path(spark, "store")).read().collect() == []


def test_compaction_goes_on_past_a_run_that_stays(spark, monkeypatch):
    s = _store(spark, target_bytes=1 << 20, fanin=3, smallest=3000)
    for n in (3, 3, 3, 4000, 4000, 4000):
        s.append(spark.range(n).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1))
    small = {x["name"] for x in s.shards() if x["bytes"] < 3000}
    write = s._write
    monkeypatch.setattr(s, "_write", lambda df, level: [write(df, level)[0] for _ in range(3)] if df.count() == 9 else write(df, level))
    s.compact()
    left = {x["name"] for x in s.shards()}
    assert len(small) == 3 and small < left and len(left) == 4 and s.read().count() == 12_009


def test_orphans(spark):
    s = _store(spark)
    s.append(spark.createDataFrame([(1, "a")], s.schema))
    named = len(s.shards())
    s._write(spark.createDataFrame([(2, "b")], s.schema), 0)  # a job that died before its commit
    assert s.clear_orphans() == 0 and s.clear_orphans(-5) >= 1 and len(s.shards()) == named and s.read().count() == 1


@pytest.mark.parametrize("name", ["x-y", "my col", "_arrival2"])
def test_odd_column_names_in_a_store(spark, name):
    df = spark.createDataFrame([(1, "a", 2)], f"doc_id bigint, text string, `{name}` int")
    assert sharding.store_of(df, common.new_path(spark, "store")).read().collect() == df.collect()
