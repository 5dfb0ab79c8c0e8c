"""Work tables, provenance, library state and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as t
from turnmill.functions import variant as v
from turnmill.functions.running import split_hot, with_running_last, with_running_sums

OUTCOMES = ["completed", "partial", "abandoned", "unclear"]


def outcome_summary(members: DataFrame, digests: DataFrame) -> DataFrame:
    """(slug, outcome_summary): counts of the members' outcomes in fixed order; no digest is unclear."""
    known = members.join(digests.select("export", "outcome"), "export", "left").select("slug", F.coalesce("outcome", F.lit("unclear")).alias("outcome"))
    counts = known.groupBy("slug").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    parts = [F.when(F.col(o) > 0, F.concat_ws(" ", F.col(o).cast("string"), F.lit(o))) for o in OUTCOMES]
    return counts.select("slug", F.concat_ws(", ", *parts).alias("outcome_summary"))


def member_rows(members: DataFrame, digests: DataFrame, manifest: DataFrame, context_rows: DataFrame, default_origin: str = "a") -> DataFrame:
    """Members with what is known of each: outcome, session, origin, and how many context rows and decisions it has.

    ``context_rows`` are many a member, so they are counted before the join.
    """
    known = context_rows.groupBy("export").agg(F.count(F.lit(1)).alias("context_rows"), F.count_if(F.col("decision_kind").isNotNull()).alias("decisions"))
    out = members.join(digests.select("export", "outcome"), "export", "left").join(manifest.select("export", "session_id", "origin"), "export", "left").join(known, "export", "left")
    return out.select("slug", "export", "pos", "outcome", F.coalesce("session_id", F.lit("unknown")).alias("session_id"), F.coalesce("origin", F.lit(default_origin)).alias("origin"),
                      F.coalesce("context_rows", F.lit(0)).alias("context_rows"), F.coalesce("decisions", F.lit(0)).alias("decisions"))


def viable_tasks(members: DataFrame, digests: DataFrame) -> DataFrame:
    """Slugs with a member that was completed or partly so."""
    good = digests.filter(F.col("outcome").isin("completed", "partial")).select("export")
    return members.join(good, "export", "left_semi").select("slug").distinct()


def distinct_domains(members: DataFrame, digests: DataFrame) -> DataFrame:
    """(slug, domains): trimmed lower-case domains in first-seen order."""
    named = members.join(digests.select("export", F.lower(t.trim_all(F.col("domain"))).alias("domain")), "export").filter("domain <> ''")
    first = named.groupBy("slug", "domain").agg(F.min("pos").alias("pos"))  # one row a domain, however many members have it
    grouped = first.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", "domain"))).alias("d"))
    return grouped.select("slug", F.transform("d", lambda x: x.domain).alias("domains"))


def task_budget(members: DataFrame, documents: DataFrame, budget: int, policy: str = "never") -> DataFrame:
    """Input size of each task against the budget: characters, dropped, coverage, status.

    ``never`` blocks a task beyond the budget; ``extreme`` cuts each member to
    its share.  Only lengths are joined, not texts.
    """
    if policy not in ("never", "extreme"):
        raise ValueError(f"unknown policy {policy!r}; known: never, extreme")
    sized = members.join(documents.select("export", F.length("content").cast("long").alias("chars")), "export", "left")
    per = sized.groupBy("slug").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("chars").isNull()).alias("unreadable"), F.sum(F.coalesce("chars", F.lit(0))).alias("chars"))
    share = sized.join(per.select("slug", F.expr(f"{budget} div members").alias("share"), F.col("chars").alias("total")), "slug")
    lost = F.when((F.col("total") > budget) & (F.col("chars") > F.col("share")), F.col("chars") - F.col("share")).otherwise(0)
    dropped = share.groupBy("slug").agg(F.sum(lost if policy == "extreme" else F.lit(0)).cast("long").alias("dropped"))
    status = F.when(F.col("unreadable") > 0, "unreadable").when((F.col("chars") > budget) & F.lit(policy == "never"), "over budget").otherwise("ready")
    out = per.join(dropped, "slug").withColumn("status", status)
    return out.select("slug", "members", "chars", "dropped", F.when(F.col("chars") > 0, (F.col("chars") - F.col("dropped")) / F.col("chars")).otherwise(1.0).alias("coverage"), "status")


def truncations(members: DataFrame, documents: DataFrame, budget: int) -> DataFrame:
    """(slug, export, dropped_chars) of the members that are cut to their share of a task beyond the budget."""
    sized = members.join(documents.select("export", F.length("content").cast("long").alias("chars")), "export")
    per = sized.groupBy("slug").agg(F.greatest(F.lit(1), F.expr(f"{budget} div count(1)")).alias("share"), F.sum("chars").alias("total")).filter(F.col("total") > budget)
    return sized.join(per, "slug").filter(F.col("chars") > F.col("share")).select("slug", "export", (F.col("chars") - F.col("share")).alias("dropped_chars"))


def author_work(tasks: DataFrame, members: DataFrame, digests: DataFrame, documents: DataFrame, library: DataFrame, generation: str, budget: int, policy: str = "never", force: bool = False) -> DataFrame:
    """One row a task with its first matching status: skipped, resumed, edited, unreadable, over budget, ready.

    ``library`` has slug, generation, members and ``is_edited``.  A stored task
    is resumed iff its generation is current and its members are the same in any
    order.
    """
    own = members.groupBy("slug").agg(F.array_sort(F.collect_list("export")).alias("now"))
    stored = library.select("slug", F.col("generation").alias("stored_generation"), F.array_sort("members").alias("stored_members"), "is_edited")
    joined = tasks.join(own, "slug", "left").join(viable_tasks(members, digests).withColumn("viable", F.lit(True)), "slug", "left").join(stored, "slug", "left")
    joined = joined.join(task_budget(members, documents, budget, policy).withColumnRenamed("status", "input"), "slug", "left")
    same = (F.col("stored_generation") == generation) & (F.col("now") == F.col("stored_members"))
    status = F.when(F.col("viable").isNull(), "skipped").when(F.coalesce(same, F.lit(False)), "resumed").when(F.coalesce("is_edited", F.lit(False)) & ~F.lit(force), "edited").otherwise(F.coalesce("input", F.lit("unreadable")))
    return joined.select("slug", status.alias("status"), "chars", "dropped", "coverage")


def provenance(work: DataFrame, tasks: DataFrame, members: DataFrame, digests: DataFrame, manifest: DataFrame, responses: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Library records of the authored tasks: sessions, preferences, outcomes, domains, coverage, cuts, hash.

    ``cuts`` are the rows of ``truncations``; without them no record lists any.
    """
    none = F.array().cast("array<struct<export:string,dropped_chars:bigint>>")
    listed = None if cuts is None else cuts.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("export", "dropped_chars"))).alias("truncations"))
    sessions = members.join(manifest.select("export", "session_id"), "export", "left").groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("pos", "export", F.coalesce("session_id", F.lit("unknown")).alias("session_id")))).alias("m"))
    work = work.withColumn("truncations", none) if listed is None else work.join(listed, "slug", "left").withColumn("truncations", F.coalesce("truncations", none))
    return (
        work.filter("status = 'ready'").join(tasks.select("slug", "title"), "slug").join(responses.select("slug", "content", "preferences", "confidence"), "slug").join(sessions, "slug")
        .join(outcome_summary(members, digests), "slug", "left").join(distinct_domains(members, digests), "slug", "left")
        .select("slug", "title", F.transform("m", lambda x: x.export).alias("members"), F.transform("m", lambda x: x.session_id).alias("session_ids"), "preferences", "outcome_summary",
                F.coalesce("domains", F.array().cast("array<string>")).alias("domains"), F.coalesce("confidence", F.lit("low")).alias("confidence"), "coverage", "dropped", "truncations", t.content_hash(F.col("content")).alias("content_hash"))
    )


def resume_work(eligible: DataFrame, done: DataFrame, key: str = "export") -> DataFrame:
    return eligible.join(done.select(key).distinct(), key, "left_anti")


def resume_note(eligible: DataFrame, done: DataFrame, key: str = "export") -> DataFrame:
    """One row (done, remaining): eligible units with and without a checkpoint; checkpoints of others don't count."""
    kept = eligible.select(key).distinct().join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    return kept.agg(F.count_if(F.col("_done")).alias("done"), F.count_if(F.col("_done").isNull()).alias("remaining"))


def stale_keys(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Digest keys that the manifest lacks; none if the manifest is empty."""
    has = manifest.limit(1).select(F.lit(True).alias("_has"))
    known = digests.select("export").distinct().join(manifest.select("export").distinct(), "export", "left_anti")
    return known.join(has, F.lit(True) == F.col("_has"), "left_semi")


def orphans(library: DataFrame, tasks: DataFrame, generation: str, force: bool = False) -> DataFrame:
    """Library rows whose slug is no current task or whose generation is old, and whether they can go."""
    current = tasks.select("slug").distinct().withColumn("_now", F.lit(True))
    out = library.join(current, "slug", "left").filter(F.col("_now").isNull() | ~F.col("generation").eqNullSafe(generation))
    return out.select("slug", F.when(F.col("is_edited") & ~F.lit(force), "kept because edited").otherwise("removable").alias("plan"))


def apply_ratings(library: DataFrame, ratings: DataFrame) -> DataFrame:
    """The latest rating of each slug set on its record; other fields stay."""
    latest = ratings.groupBy("slug").agg(F.max_by("rating", "rated_at").alias("_rating"), F.max("rated_at").alias("_at"))
    return library.drop("rating", "rated_at").join(latest, "slug", "left").withColumnsRenamed({"_rating": "rating", "_at": "rated_at"})


def funnel(manifest: DataFrame, digests: DataFrame, tasks: DataFrame, misc: DataFrame, library: DataFrame, generation: str, sessions: DataFrame | None = None) -> DataFrame:
    """(stage, n) from discovered (if the ``sessions`` of the stores are given) to authored, one row a stage."""
    grouped = tasks.select(F.explode("members").alias("export")).distinct()
    authored = library.filter(F.col("generation").eqNullSafe(generation)).join(tasks.select("slug"), "slug", "left_semi")
    stage = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
    digested = digests.join(manifest.select("export"), "export", "left_semi")
    first = stage("exported", manifest) if sessions is None else stage("discovered", sessions).union(stage("exported", manifest))
    return first.union(stage("digested", digested)).union(stage("clustered", grouped)).union(stage("misc", misc)).union(stage("authored", authored)).union(stage("tasks", tasks))


def task_marks(tasks: DataFrame, members: DataFrame, digests: DataFrame, library: DataFrame, generation: str) -> DataFrame:
    """(slug, mark): authored, skipped with its outcomes, or pending."""
    now = library.filter(F.col("generation").eqNullSafe(generation)).select("slug").distinct().withColumn("_now", F.lit(True))
    good = viable_tasks(members, digests).withColumn("_good", F.lit(True))
    out = tasks.select("slug").join(now, "slug", "left").join(good, "slug", "left").join(outcome_summary(members, digests), "slug", "left")
    return out.select("slug", F.when(F.col("_now"), "authored").when(F.col("_good").isNull(), F.concat(F.lit("skipped: "), F.coalesce("outcome_summary", F.lit("")))).otherwise("pending").alias("mark"))


def group_by_folder(sessions: DataFrame) -> DataFrame:
    """Sessions of both stores by working folder: (cwd, sessions, latest); no folder is ''."""
    return sessions.groupBy(F.coalesce("cwd", F.lit("")).alias("cwd")).agg(F.count(F.lit(1)).alias("sessions"), F.max("mtime").alias("latest"))


def failure_streaks(runs: DataFrame, run: str, order: list[str], trip: int = 5, hot_rows: int | None = None) -> DataFrame:
    """Runs of equal consecutive failures: one row a streak that reached ``trip``.

    ``message`` is null for a success and ``kind`` is ``skipped`` for items that
    neither extend nor reset a streak.  With ``hot_rows``, a run of more items is
    cut into stretches, which pass their number of items, last message and number
    of streaks on to each other.
    """
    items = runs.filter(F.coalesce(F.col("kind"), F.lit("")) != "skipped")
    small, hot = (items, None) if hot_rows is None else split_hot(items, [run], hot_rows)
    own = Window.partitionBy(run).orderBy(*order)
    begins = lambda before, n: F.when(F.col("message").eqNullSafe(before) & (n > 1), 0).otherwise(1)
    placed = small.select(run, "message", *order, F.row_number().over(own).cast("long").alias("n"), F.lag("message").over(own).alias("before"))
    marked = placed.select(run, "message", "n", F.sum(begins(F.col("before"), F.col("n"))).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    if hot is not None:
        by = [F.col(c) for c in order]
        placed = with_running_sums(hot.select(run, "message", *order), run, by, {"n": F.lit(1)}).withColumn("n", F.col("n") + 1)
        placed = with_running_last(placed, [run], [F.col("n")], {"before": F.struct("message")}).withColumn("begins", begins(F.col("before.message"), F.col("n")))
        summed = with_running_sums(placed, run, [F.col("n")], {"island": F.col("begins")})
        marked = marked.unionByName(summed.select(run, "message", "n", (F.col("island") + F.col("begins")).alias("island")))
    total = items.groupBy(F.col(run).alias("_run")).agg(F.count(F.lit(1)).alias("total"))
    out = marked.filter("message is not null").groupBy(run, "island", "message").agg(F.min("n").alias("first_n"), F.count(F.lit(1)).alias("length"))
    out = out.filter(F.col("length") >= trip).join(total, F.col(run).eqNullSafe(F.col("_run"))).filter(F.col("total") > trip)
    return out.select(run, "message", F.col("first_n").cast("int").alias("first_n"), "length", (F.col("total") - F.col("first_n") - trip + 1).alias("not_attempted"))


def parse_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """Model responses unwrapped: ``is_error``, ``payload`` (variant), ``cost``.

    An object is itself; of an array the last ``result`` event counts, else its
    last element if that has a result or an error flag.  A string result has its
    fence stripped and is parsed.
    """
    whole = v.parse(F.col(column))
    events = v.array(whole, "$")
    results = F.filter(events, lambda e: v.text(e, "$.type") == "result")
    last = F.try_element_at(events, F.lit(-1))
    shaped = F.when(v.at(last, "$.result").isNotNull() | v.at(last, "$.is_error").isNotNull(), last)
    envelope = F.when(v.is_object(whole), whole).otherwise(F.coalesce(F.try_element_at(results, F.lit(-1)), shaped))
    out = responses.withColumn("_e", envelope)
    said = v.text(F.col("_e"), "$.result")
    payload = F.when(said.isNotNull(), v.parse(t.strip_fence(said))).when(v.is_object(v.at(F.col("_e"), "$.result")), v.at(F.col("_e"), "$.result")).when(v.at(F.col("_e"), "$.result").isNull(), F.coalesce(F.col("_e"), v.parse(t.strip_fence(F.col(column)))))
    cost = F.coalesce(F.regexp_extract(F.col(column), r"Credits:\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
    return out.withColumn("is_error", v.truthy(F.col("_e"), "$.is_error")).withColumn("payload", payload).withColumn("cost", cost).drop("_e")


def response_cost(parsed: DataFrame, run: str) -> DataFrame:
    """(run, cost) of each run."""
    return parsed.groupBy(run).agg(F.sum("cost").alias("cost"))


def _each(payload: Column, path: str, fields: list[str], lists: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> Column:
    """Whether ``path`` is a list of objects with these strings, lists of strings and numbers."""
    def good(x: Column) -> Column:
        out = v.is_object(x)
        for f in fields:
            out = out & v.text(x, f"$.{f}").isNotNull()
        for f in lists:
            out = out & F.coalesce(F.forall(v.array(x, f"$.{f}"), lambda i: v.string(i).isNotNull()), F.lit(False))
        for f in numbers:
            out = out & v.number(x, f"$.{f}").isNotNull()
        return out

    return F.coalesce(F.forall(v.array(payload, path), good), F.lit(False))


def cluster_problem(payload: Column) -> Column:
    """Why a grouping of sessions is invalid, or null."""
    misc = F.coalesce(F.forall(v.array(payload, "$.misc"), lambda i: v.string(i).isNotNull()), F.lit(False))
    return F.when(~v.is_object(payload), "not an object").when(~_each(payload, "$.tasks", ["slug", "title", "rationale"], ("members",)), "bad tasks").when(~misc, "bad misc")


def merge_problem(payload: Column) -> Column:
    """Why a merge of tasks is invalid, or null."""
    return F.when(~v.is_object(payload), "not an object").when(~_each(payload, "$.merges", ["slug", "title", "rationale"], ("slugs",)), "bad merges")


def author_problem(payload: Column, minimum: int = 120, body: str = "content") -> Column:
    """Why an authored task is invalid, or null."""
    return (
        F.when(~v.is_object(payload), "not an object").when(v.text(payload, "$.slug").isNull(), "missing slug").when(v.text(payload, "$.title").isNull(), "missing title")
        .when(v.text(payload, f"$.{body}").isNull(), "missing body").when(F.length(v.text(payload, f"$.{body}")) < minimum, "body too short")
        .when(~F.coalesce(v.text(payload, "$.confidence").isin("high", "medium", "low"), F.lit(False)), "bad confidence")
        .when(~_each(payload, "$.preferences", ["text", "evidence"]), "bad preferences")
    )


def consolidate_problem(payload: Column) -> Column:
    """Why a consolidated list of preferences is invalid, or null."""
    return F.when(~v.is_object(payload), "not an object").when(~_each(payload, "$.preferences", ["text"], numbers=("merged_from",)), "bad preferences")


def digest_problem(payload: Column) -> Column:
    """Why a digest payload is invalid, or null."""
    outcome = v.text(payload, "$.outcome")
    problem = F.when(~v.is_object(payload), "not an object")
    for name in ("goal", "deliverable", "domain"):
        problem = problem.when(v.text(payload, f"$.{name}").isNull(), f"missing {name}")
    return problem.when(v.array(payload, "$.keywords").isNull(), "missing keywords").when(outcome.isNull() | ~outcome.isin(OUTCOMES), "bad outcome")


def library_view(library: DataFrame) -> DataFrame:
    """What a listing shows of each record, newest first; edited flag, rating and words where the library has them."""
    has = set(library.columns)
    more = [F.coalesce("is_edited", F.lit(False)).alias("edited")] if "is_edited" in has else []
    more += ["rating"] if "rating" in has else []
    more += [t.word_count(t.parse_document(F.col("content"))["body"]).alias("words")] if "content" in has else []
    shown = library.select("slug", "title", F.array_join("domains", ", ").alias("domains"), F.size("members").alias("members"), "confidence", F.left("authored_at", F.lit(10)).alias("authored"),
                           F.when(F.col("coverage") < 1, F.concat(F.floor(F.col("coverage") * 100 + 0.5).cast("string"), F.lit("%"))).alias("coverage"), *more)
    return shown.repartition("slug").orderBy(F.desc("authored"), "slug")  # a sort reads its input twice: here short rows, not the texts
