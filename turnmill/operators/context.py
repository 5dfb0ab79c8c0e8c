"""What short human turns answered, and how sessions ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as t
from turnmill.functions.running import split_hot, with_running_last
from turnmill.sources.lines import KEYS

HOT_EVENTS = 500_000  # of a session from which it is many tasks' work


def short_turn_context(events: DataFrame, corpus: DataFrame, words: int = t.SHORT_WORDS, chars: int = t.TAIL_CHARS, hot_rows: int | None = None) -> DataFrame:
    """For each owned human turn of at most ``words`` words, the context it answered.

    ``antecedent``: tail of the nearest earlier assistant text, unless a boundary
    lies between.  ``decision_kind`` and ``decision_text``: the latest plan or
    question since the previous human turn and the last boundary.  Both are
    backward as-of lookups, done in one running window a session; texts are
    trimmed before it.  With ``hot_rows``, sessions of more events are cut into
    stretches, which pass their last assistant text, decision, boundary and turn
    on to each other; the events are then counted first, so they should be a table.
    """
    kind, pos = F.col("kind"), F.col("event_pos")
    shown = F.when(kind == "assistant", t.tail(F.col("text"), chars)).when(kind.isin("plan", "question"), F.col("text"))
    latest = lambda on: F.when(on, F.struct(pos.alias("at"), kind.alias("kind"), shown.alias("text")))
    found = {"said": latest(kind == "assistant"), "asked": latest(kind.isin("plan", "question")), "wall": F.when(kind == "boundary", pos), "turn": F.when(kind == "human", pos)}
    seen = events.select(*KEYS, "event_pos", "kind", "timestamp", "text")
    small, hot = (seen, None) if hot_rows is None else split_hot(seen, KEYS, hot_rows)
    before = Window.partitionBy(*KEYS).orderBy("event_pos").rowsBetween(Window.unboundedPreceding, -1)
    looked = small.select("*", *(F.last(c, ignorenulls=True).over(before).alias(name) for name, c in found.items()))
    if hot is not None:
        looked = looked.unionByName(with_running_last(hot, KEYS, [F.col("event_pos")], found))
    looked = looked.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("wall", "turn")})
    said, asked = F.col("said.at") > F.col("wall"), (F.col("asked.at") > F.col("wall")) & (F.col("asked.at") > F.col("turn"))
    short = looked.filter((kind == "human") & t.is_short_turn(F.col("text"), words)).select(
        *KEYS, "event_pos", "timestamp", "text", F.when(said, F.col("said.text")).alias("antecedent"),
        F.when(asked, F.col("asked.kind")).alias("decision_kind"), F.when(asked, F.col("asked.text")).alias("decision_text"))
    owned = short.join(corpus.select(*KEYS, "timestamp", "text", "index"), [*KEYS, "timestamp", "text"])
    first = F.row_number().over(Window.partitionBy(*KEYS, "index").orderBy("event_pos"))
    return owned.withColumn("_n", first).filter("_n = 1").select(*KEYS, "index", "timestamp", F.col("text").alias("human_text"), "antecedent", "decision_kind", "decision_text")


def outcome_evidence(events: DataFrame, corpus: DataFrame, last: int = 3, chars: int = t.TAIL_CHARS) -> DataFrame:
    """The last human turns (oldest first) of each session and the tail of its last assistant text."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("index")))
    turns = corpus.withColumn("_n", rank).filter(F.col("_n") <= last).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("index", "text"))).alias("turns"))
    said = events.filter("kind = 'assistant'").select(*KEYS, "event_pos", t.tail(F.col("text"), chars).alias("text")).groupBy(*KEYS).agg(F.max_by("text", "event_pos").alias("tail"))
    return turns.join(said, KEYS, "left").select(*KEYS, F.transform("turns", lambda x: x.text).alias("final_human_turns"), F.coalesce("tail", F.lit("")).alias("final_assistant_tail"))
