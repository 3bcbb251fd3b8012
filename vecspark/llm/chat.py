"""Chat formatting of reply trees (operator 7).

Messages point to their parents. Self-joins that double their reach give each message its 1st, 2nd, 4th, ...
ancestor; a second series lists, for each leaf, the messages of its path, so a tree of depth d takes 2 log2(d)
joins and no task follows a chain. Branches are ranked by their messages' mean score (ties by leaf) and the
``top`` of each conversation are formatted.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn. A backslash is doubled and one is put after
the first character of any control string inside a role or text, so no control string is left there and
removing the backslashes gives the text back; a line break in a role is a backslash and an n.

Defined cases: null text and null role are empty; a null score counts as 0; a null conversation id is a
conversation of its own; a missing or null parent makes a root; messages on a cycle have no leaf and are left
out; of messages that repeat a node the first by role and text is kept, while turns of a linear table that
repeat a number are all kept, ordered by role and text; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, written

#: Strings with a meaning in this template or in other common ones.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_MARK = re.compile(r"(\\)|(" + "|".join(map(re.escape, CONTROL)) + ")")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(lambda m: "\\\\" if m[1] else m[2][0] + "\\" + m[2][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n]?)", lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turns(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{escape_role(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def linear(conversations: DataFrame) -> DataFrame:
    """Rows by turn as messages: each turn answers the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(w).cast("long").alias("node"), "role", "text").select("conv_id", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """``(conv_id, leaf, branch, turns)`` of the best branches; turns are (role, text) from the root."""
    ck = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    rows = messages.where("node is not null").select("conv_id", ck.alias("ck"), F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.groupBy("ck", "node").agg(F.min(F.struct("role", "text", "parent", "score", "conv_id")).alias("m")).select("ck", "node", "m.*")
    rows = written(rows, "messages")
    nodes = rows.select("ck", F.col("node").alias("anc"))
    reach = [written(rows.select("ck", "node", F.col("parent").alias("anc")).join(nodes, ["ck", "anc"], "left_semi").select("ck", "node", "anc"), "reach")]
    size = reach[0].count()
    limit = max(1, size).bit_length() + 1
    while size and len(reach) <= limit:
        far = reach[-1].select("ck", F.col("node").alias("anc"), F.col("anc").alias("up"))
        reach.append(written(reach[-1].join(far, ["ck", "anc"]).select("ck", "node", F.col("up").alias("anc")), "reach"))
        size = reach[-1].count()
    parents = reach[0].select("ck", F.col("anc").alias("node")).distinct()
    paths = rows.select("ck", "node").join(parents, ["ck", "node"], "left_anti").select("ck", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    for k in reversed(range(len(reach) - 1)):
        step = reach[k].select("ck", "node", "anc")
        both = F.array(F.struct(F.col("node").alias("node"), F.col("dist").alias("dist")), F.struct(F.col("anc").alias("node"), (F.col("dist") + (1 << k)).alias("dist")))
        own = F.array(F.struct(F.col("node").alias("node"), F.col("dist").alias("dist")))
        paths = paths.join(step, ["ck", "node"], "left").select("ck", "leaf", F.explode(F.when(F.col("anc").isNull(), own).otherwise(both)).alias("x")).select("ck", "leaf", "x.node", "x.dist")
    full = paths.join(rows.select("ck", "node", "role", "text", "score", "conv_id"), ["ck", "node"])
    branches = full.groupBy("ck", "leaf").agg(F.first("conv_id").alias("conv_id"), F.avg("score").alias("mean"), F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), "role", "text"))).alias("turns"))
    if top:
        best = full.groupBy("ck", "leaf").agg(F.avg("score").alias("mean"))
        w = Window.partitionBy("ck").orderBy(F.desc("mean"), "leaf")
        best = best.withColumn("branch", F.row_number().over(w)).where(F.col("branch") <= top).select("ck", "leaf", "branch")
        branches = branches.join(best, ["ck", "leaf"])
    else:
        branches = branches.withColumn("branch", F.lit(0))
    return branches.select("conv_id", "leaf", "branch", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def formatted_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """``(conv_id, leaf, branch, formatted)`` of each chosen path."""

    def run(batches):
        for b in batches:
            out = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("leaf"), b.column("branch"), pa.array(out, pa.string())], ["conv_id", "leaf", "branch", "formatted"])

    return reply_paths(messages, top).mapInArrow(run, "conv_id long, leaf long, branch int, formatted string")


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """The spans of the formatted text that training takes the loss of: the assistant's texts."""
    return [m.span(2) for m in _TURN.finditer(formatted) if unescape_role(m[1]) == "assistant"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts say, read from them alone."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column("formatted").to_pylist():
                turns = read_turns(text)
                loss = "".join(unescape(text[s:e]) for s, e in loss_spans(text))
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(x, k) for x, k in zip(cols, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return read_back(formatted_paths(linear(rows.unionByName(extra))))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t(conv_id, turn, role, text)),
     p AS (SELECT *, '\\|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>' AS mark FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(text) + len(regexp_extract_all(text, mark)) + length(role) + len(regexp_extract_all(role, mark)) + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
