"""Scripts made of the driver's conversations, so that every kind of markup occurs; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import ordered_join
from inkwell.session import ship
from inkwell.sources.scripts import scripts_from

#: Markup put before a turn, chosen by conversation and turn.
INSERTS = [
    "", "> CUT TO:", "[[A note on the scene.]]", "# Act one", "/* struck out */", "/*\nstruck\nout\n*/", "= What happens here.", "===",
    "> THE END <", ".THE ROOF #12A#", "~Sing along\n~once more", "!LOUD NOISES", "EXT. GARDEN - NIGHT\nStraight on.", "SMASH CUT TO:", "FADE OUT.",
    "He waits.\nAnd *waits* for _it_.", "@McAvoy\n(softly)\nNo.\n  \nYes.", "## Part two", "/* open\nnever ends on this line", "ends here */",
]
HEAD = ["Title: Conversation {}\nAuthor:\n\tFirst Person\n\tSecond: Person\nDraft date: day {}\n\nINT. ROOM {} - DAY #{}#\n\n", "FADE IN:\n\nEST. PLACE {} - DAWN {} {} {}\n\n"]


def conversation_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script per conversation, its turns in order."""
    turns = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("conv_id").isNotNull())
    pick = F.pmod(F.col("conv_id") * 7 + F.coalesce("turn", F.lit(0)), F.lit(len(INSERTS)))
    insert = F.element_at(F.array(*map(F.lit, INSERTS)), (pick + 1).cast("int"))
    caret = F.when(F.pmod(F.col("conv_id") + F.coalesce("turn", F.lit(0)), F.lit(3)) == 0, " ^").otherwise("")
    cue = F.concat(F.upper(F.coalesce("role", F.lit("nobody"))), caret)
    block = F.concat(insert, F.lit("\n\n"), cue, F.lit("\n"), F.coalesce("text", F.lit("")))
    bodies = turns.groupBy("conv_id").agg(ordered_join([F.coalesce("turn", F.lit(0))], block, "\n\n").alias("body"))
    number = F.col("conv_id").cast("string")
    heads = []
    for head in HEAD:
        parts = head.split("{}")
        heads.append(F.concat(*[x for part in parts[:-1] for x in (F.lit(part), number)], F.lit(parts[-1])))
    text = F.concat(F.when(F.col("conv_id") % 4 == 3, heads[1]).otherwise(heads[0]), "body")
    return scripts_from(bodies, "conv_id", text)


def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts_from(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _head_sql(head: str) -> str:
    return " || conv_id::VARCHAR || ".join(quoted(part) for part in head.split("{}"))


CONVERSATION_SQL = f"""scripts AS (SELECT conv_id AS script_id,
  (CASE WHEN conv_id % 4 = 3 THEN {_head_sql(HEAD[1])} ELSE {_head_sql(HEAD[0])} END) || body AS text
  FROM (SELECT conv_id, string_agg(
      ([{", ".join(map(quoted, INSERTS))}])[((conv_id * 7 + coalesce(turn, 0)) % {len(INSERTS)} + 1)::INT]
      || chr(10) || chr(10) || upper(coalesce(role, 'nobody')) || (CASE WHEN (conv_id + coalesce(turn, 0)) % 3 = 0 THEN ' ^' ELSE '' END)
      || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY coalesce(turn, 0), text) AS body
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id))"""
DOCUMENT_SQL = "scripts AS (SELECT doc_id AS script_id, text FROM documents WHERE text IS NOT NULL)"
