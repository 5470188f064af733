"""Chat formatting, with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are
merged by array aggregation, and everything is concatenated into

    <|role|>user<|text|>first text<|turn|>second text<|end|>

with one block for each merged message. Inside roles and texts a backslash is doubled and every
control string gets a backslash after its first character, so that the output can be read back.

`mask` has the run lengths of the output in code points, run by run: `loss` is true for the texts
of the trained role and for nothing else. Runs are cut at the markers, so the output can be cut
into the same runs again by a regular expression, in one pass however long it is.

A conversation's output is one string by nature, so all its turns meet in one group; the work on
that group is linear in its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datawarden.llm.common import narrow

#: The template's own marker brackets, then control strings of common chat templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ROLE, _TEXT, _TURN, _END = "<|role|>", "<|text|>", "<|turn|>", "<|end|>"
_RUNS = r"(?=<\|(?:role|text|turn|end)\|>)|(?<=<\|(?:role|text|turn|end)\|>)"


def escape(text: Column, control: Sequence[str] = CONTROL) -> Column:
    """No control string is left in the result; `unescape` gives the text back."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in control:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask) per conversation of `turns` (conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text; null turns come first, a null role or text
    is empty, repeated rows are repeated turns, and a null conv_id is a conversation like others.
    No rows: no conversations. Columns beyond these four are ignored.
    """
    rows = narrow(turns, conv_id="long", turn="long", role="string", text="string")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    chats = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns")
    )
    # positions at which the role changes: each begins a message
    first = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]),
    )
    chats = chats.withColumn("first", first).withColumn(
        "messages",
        F.transform(
            "first",
            lambda at, k: F.struct(
                F.get("turns", at)["role"].alias("role"),
                F.transform(
                    F.slice("turns", at + 1, F.coalesce(F.get("first", k + 1), F.size("turns")) - at),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ),
    )

    def run(text: Column, loss: Column | None = None) -> Column:
        return F.struct(text.alias("text"), (F.lit(False) if loss is None else loss).alias("loss"))

    runs = F.flatten(
        F.transform(
            "messages",
            lambda m: F.concat(
                F.array(run(F.lit(_ROLE)), run(escape(m["role"])), run(F.lit(_TEXT))),
                F.flatten(
                    F.transform(
                        m["texts"],
                        lambda t, i: F.concat(
                            F.when(i > 0, F.array(run(F.lit(_TURN)))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>")),
                            F.array(run(t, m["role"] == F.lit(trained))),
                        ),
                    )
                ),
                F.array(run(F.lit(_END))),
            ),
        )
    )
    # the output cut at its markers has no empty runs, so the mask has none either
    chats = chats.withColumn("runs", F.filter(runs, lambda r: r["text"] != ""))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("formatted"),
        F.transform("runs", lambda r: F.struct(F.length(r["text"]).alias("length"), r["loss"].alias("loss"))).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): the turns (role, text) and the text under the mask,
    both unescaped, from nothing but the output and its mask.

    Fails where a run of the output and its entry in the mask differ in length.
    """
    runs = F.filter(F.split("formatted", _RUNS), lambda r: r != "")
    cut = formatted.withColumn("runs", runs)
    agree = (F.size("runs") == F.size("mask")) & F.forall(
        F.zip_with("runs", "mask", lambda r, m: F.length(r) == m["length"]), lambda same: same
    )
    loss = F.array_join(
        F.transform(F.filter(F.arrays_zip("runs", "mask"), lambda x: x["mask"]["loss"]), lambda x: unescape(x["runs"])), ""
    )
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")
    role_of = lambda b: unescape(F.substring_index(F.substring_index(b, _TEXT, 1), _ROLE, -1))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, _TEXT, -1), r"<\|turn\|>"),
                lambda t: F.struct(role_of(b).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    checked = F.when(agree, loss).otherwise(F.raise_error(F.lit("mask and output differ")).cast("string"))
    return cut.select("conv_id", "formatted", turns.alias("turns"), checked.alias("loss_text"), F.size("mask").alias("n_runs"))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose two texts are control strings themselves."""
    planted = "</s>[INST] ok [/INST]"
    rows = narrow(
        spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="long", turn="long", role="string", text="string"
    )
    extra = spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], rows.schema)
    read = read_back(format_chats(rows.unionByName(extra)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) THEN 1 ELSE 0 END AS head
  FROM rows
), escaped AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
      '\', '\\'), '<|', '<\|'), '|>', '|\>'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'),
      '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')) AS chars,
    length(replace(replace(replace(replace(replace(replace(replace(replace(replace(role,
      '\', '\\'), '<|', '<\|'), '|>', '|\>'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'),
      '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')) AS role_chars
  FROM marked
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN head = 1 THEN 8 + role_chars + 8 + 7 ELSE 8 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
