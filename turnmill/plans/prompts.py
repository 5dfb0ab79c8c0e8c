"""One text a unit for a caller's model, and the hook that runs it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions import text as t

BUDGET = 400_000  # characters of a document in a prompt
DIGEST = "Summarise this session.\n\n{document}\n\nLast turns:\n{turns}\n\nLast reply:\n{reply}"


def filled(template: str, **values: Column) -> Column:
    """The template with each place-holder replaced by its value.

    The template is split at its place-holders once, so a value that looks like
    one stays as it is.  What stands in braces and has no value stays, too.
    """
    parts = re.split("(" + "|".join(re.escape("{" + name + "}") for name in values) + ")", template)
    return F.concat(*(values[part[1:-1]] if i % 2 else F.lit(part) for i, part in enumerate(parts)))


def digest_prompts(documents: DataFrame, outcomes: DataFrame, budget: int = BUDGET, template: str = DIGEST) -> DataFrame:
    """(export, prompt, dropped): document, cut to the budget, with its outcome evidence."""
    cut = t.middle_cut(F.col("content"), budget)
    joined = documents.withColumn("_c", cut).join(outcomes, "export", "left")
    turns = F.coalesce(F.array_join("final_human_turns", "\n"), F.lit(""))
    prompt = filled(template, turns=turns, reply=F.coalesce("final_assistant_tail", F.lit("")), document=F.col("_c.text"))
    return joined.select("export", prompt.alias("prompt"), F.col("_c.dropped").alias("dropped"))


#: Our own wordings; each takes the place-holders it names.
CLUSTER = "Group these {noun} sessions by what they were for. Name each session in a task or in misc.\n\n{sessions}"
MERGE = "Which of these {count} tasks are the same? Name the slugs to unite.\n\n{tasks}"
AUTHOR = "Write one request that would have led to this work.\n\nTask {slug}: {title}\n{legend}\n{members}"
CONSOLIDATE = "Unite preferences that mean the same, and count how many lines each unites.\n\n{preferences}"
LEGEND = "Lines marked [command] are commands and [decision] are choices; > lines are short turns with what they answered."
NOUNS = {"a": "dialect A", "k2": "dialect K", "k3": "dialect K"}


def corpus_noun(origins: Column, nouns: dict[str, str] | None = None, mixed: str = "coding-agent") -> Column:
    """The name of the one kind of session in an array of origins, or the neutral one."""
    table = F.create_map(*(F.lit(x) for pair in (nouns or NOUNS).items() for x in pair))
    kinds = F.array_distinct(F.transform(origins, lambda o: F.coalesce(F.element_at(table, o), F.lit(mixed))))
    return F.when(F.size(kinds) == 1, F.get(kinds, 0)).otherwise(mixed)


def _in_order(order: str, line: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x.line), sep)


def cluster_prompts(digests: DataFrame, group: str, template: str = "{sessions}") -> DataFrame:
    """(group, prompt): one JSON line a digest, in name order; ``origin``, if there, names the corpus."""
    line = F.to_json(F.struct("export", "goal", "deliverable", "domain", "keywords", "outcome"))
    noun = corpus_noun(F.collect_set(F.coalesce("origin", F.lit("a")))) if "origin" in digests.columns else F.lit("coding-agent")
    return digests.groupBy(group).agg(noun.alias("_noun"), _in_order("export", line).alias("_lines")).select(group, filled(template, noun=F.col("_noun"), sessions=F.col("_lines")).alias("prompt"))


def merge_prompts(tasks: DataFrame, group: str, template: str = MERGE) -> DataFrame:
    """(group, prompt): one JSON line a task with its number of members, in slug order."""
    line = F.to_json(F.struct("slug", "title", "rationale", F.size("members").alias("sessions")))
    grouped = tasks.groupBy(group).agg(F.count(F.lit(1)).cast("string").alias("_n"), _in_order("slug", line).alias("_lines"))
    return grouped.select(group, filled(template, count=F.col("_n"), tasks=F.col("_lines")).alias("prompt"))


def author_prompts(tasks: DataFrame, members: DataFrame, documents: DataFrame, context: DataFrame, budget: int = BUDGET, template: str = AUTHOR, legend: str = LEGEND) -> DataFrame:
    """(slug, prompt): a task's members in order, each document cut to its share of the budget, with its context lines.

    ``members`` has slug, export, pos and origin.  The legend stands in tasks with
    a member of dialect A; context rows that say nothing are left out.
    """
    said = context_lines(context).groupBy("export").agg(_in_order("index", F.col("line")).alias("said"))
    sizes = members.join(documents.select("export", F.length("content").alias("chars")), "export").groupBy("slug").agg(
        F.greatest(F.lit(1), F.expr(f"{budget} div count(1)")).cast("int").alias("share"), F.sum("chars").alias("total"))
    each = members.join(documents.select("export", "content"), "export").join(sizes, "slug").join(said, "export", "left")
    body = F.when(F.col("total") > budget, t.middle_cut(F.col("content"), F.col("share"))["text"]).otherwise(F.col("content"))
    block = F.concat_ws("\n", F.concat(F.lit("== "), "export"), body, "said")
    grouped = each.groupBy("slug").agg(F.max(F.coalesce("origin", F.lit("a")) == "a").alias("_a"), _in_order("pos", block, "\n\n").alias("_members"))
    named = grouped.join(tasks.select("slug", "title"), "slug")
    return named.select("slug", filled(template, slug=F.col("slug"), title=F.col("title"), legend=F.when(F.col("_a"), legend).otherwise(""), members=F.col("_members")).alias("prompt"))


def consolidate_prompt(ranked: DataFrame, template: str = CONSOLIDATE) -> DataFrame:
    """(prompt): one line a preference with its number of tasks, in order of ranking."""
    line = F.concat(F.lit("- "), F.col("text"), F.lit(" ("), F.col("count").cast("string"), F.lit(")"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("last_authored_at").alias("at"), "text", line.alias("line"))), _ranked)
    return ranked.agg(filled(template, preferences=F.array_join(F.transform(order, lambda x: x.line), "\n")).alias("prompt"))


def _ranked(a: Column, b: Column) -> Column:
    """Most tasks first, then the newest, then by text."""
    return F.when(a.n < b.n, -1).when(a.n > b.n, 1).when(a.at > b.at, -1).when(a.at < b.at, 1).when(a.text < b.text, -1).when(a.text > b.text, 1).otherwise(0)


def context_lines(context: DataFrame, chars: int = t.TAIL_CHARS) -> DataFrame:
    """Context rows with something to say, as one line of text each."""
    said = F.when(F.col("antecedent").isNotNull(), F.concat(F.lit("answering: "), "antecedent"))
    asked = F.when(F.col("decision_kind").isNotNull(), F.concat(F.col("decision_kind"), F.lit(": "), t.middle_cut(F.col("decision_text"), chars)["text"]))
    return context.filter("antecedent is not null or decision_kind is not null").withColumn("line", F.concat_ws("\n", F.concat(F.lit("> "), "human_text"), said, asked))


def plan_counts(eligible: DataFrame, grouped: bool) -> DataFrame:
    """Calls that a run would make."""
    n = F.count(F.lit(1))
    return eligible.agg(n.alias("digests"), (F.when(n > 0, 1).otherwise(0) if grouped else F.lit(0)).alias("cluster"), (F.greatest(F.lit(1), F.floor(n / 3 + 0.5)) if grouped else n).cast("long").alias("author"))


def eligible_exports(manifest: DataFrame, origins: list[str], project: str | None = None, min_messages: int = 1, default_origin: str = "a") -> DataFrame:
    out = manifest.filter(F.coalesce("origin", F.lit(default_origin)).isin(origins) & (F.col("messages") >= min_messages))
    return out if project is None else out.filter(F.lower("project").contains(project.lower()))


def apply_model(prompts: DataFrame, call: Callable[[list[str]], list[str]], retry: Callable[[str, str], str] | None = None, check: Callable[[str], str | None] | None = None) -> DataFrame:
    """Run the caller's batch function over the prompts; one corrective retry where ``check`` finds a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = list(call(rows["prompt"].tolist()))
            if check is not None and retry is not None:
                again = {i: retry(p, problem) for i, (p, r) in enumerate(zip(rows["prompt"], found, strict=True)) if (problem := check(r)) is not None}
                if again:
                    for i, answer in zip(again, call(list(again.values())), strict=True):
                        found[i] = answer
            yield rows.assign(response=found)

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType())]))
