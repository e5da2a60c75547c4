"""Chat formatting as relational expressions: sort the collected turns, merge runs of one role, concatenate.

A conversation becomes blocks, one for each run of turns of one role:

    \\n<|im_start|>ROLE\\nTEXT\\n<|im_sep|>\\nTEXT\\n<|im_end|>

Every control string of this template (and those of other common ones) inside a text gets a backslash before it and before the
backslashes that already stand there, so taking one backslash away gives the text back. A real mark always follows a line end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import common as C

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings that are escaped in texts.
CONTROLS = (START, SEP, END, "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
_ANY = "(?:" + "|".join(re.escape(c).replace("/", "/") for c in CONTROLS) + ")"
_ESCAPE, _UNESCAPE = r"(\\*)(" + _ANY + ")", r"\\(\\*)(" + _ANY + ")"
TURN = "array<struct<turn:bigint,role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def _role(role: Column) -> Column:
    """A role on one line, reversibly."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss (array of struct(start, length), in code points of formatted) for each conversation.

    Turns go by number, equal numbers by role, then text; repeated rows stay. Null text and role count as empty, a null turn comes first;
    rows whose conv_id is null form one conversation. Other columns are dropped first, so names can't clash. A conversation is one value,
    so it must fit in memory, as its formatted text must.
    """
    rows = turns.select(
        C.col(conv_id).alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Runs: a turn opens a block if its role differs from the one before it.
    numbered = F.transform(F.col("ts"), lambda t, i: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"), ((i == 0) | (F.get(F.col("ts"), i - 1)["role"] != t["role"])).alias("opens"), (F.get(F.col("ts"), i + 1)["role"].isNull() | (F.get(F.col("ts"), i + 1)["role"] != t["role"])).alias("closes")))
    pieces = got.withColumn("ts", numbered).withColumn(
        "ps",
        F.transform(
            "ts",
            lambda t: F.struct(
                F.when(t["opens"], F.concat(F.lit(f"\n{START}"), _role(t["role"]), F.lit("\n"))).otherwise(F.lit(f"\n{SEP}\n")).alias("head"),
                t["text"].alias("text"),
                F.when(t["closes"], F.lit(f"\n{END}")).otherwise(F.lit("")).alias("tail"),
                t["role"].isin(*loss_roles).alias("loss"),
            ),
        ),
    )
    ends = F.aggregate(
        "ps",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["text"]) + F.length(p["tail"])).cast("bigint").alias("at"),
            F.when(p["loss"], F.array_append(s["spans"], F.struct((s["at"] + F.length(p["head"])).cast("bigint").alias("start"), F.length(p["text"]).cast("bigint").alias("length")))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    text = F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    return pieces.select("conv_id", text.alias("formatted"), ends["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss, turns (array of struct(role, text)), loss_text: from the formatted text and its mask alone."""
    blocks = F.split(F.col("formatted"), re.escape(f"\n{END}"))
    inner = F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.substring(b, F.lit(len(START) + 2), F.length(b)))
    turns = F.flatten(
        F.transform(
            inner,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, "\n") + 1, F.length(b)), re.escape(f"\n{SEP}\n")),
                lambda t: F.struct(_unrole(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", "formatted", "loss", turns.alias("turns"), loss.alias("loss_text"))


def digest(back: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    return digest(read_back(format_conversations(turns.unionByName(more))))


_CONTROL_SQL = "(" + "|".join(re.escape(c).replace("'", "''") for c in CONTROLS) + ")"
ORACLE_SQL = {
    "op5_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
         length(regexp_replace(text, '{_CONTROL_SQL}', '\\\\\\1', 'g')) AS n_escaped, row_number() OVER w AS k
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_escaped + CASE WHEN opens THEN {len(START) + 2} + length(role) ELSE {len(SEP) + 2} END + CASE WHEN closes THEN {len(END) + 1} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
""",
}
QUERIES = {"op5_chat_format": op5_chat_format}
