"""Selection of events under a token budget, and the rendered block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import count_tokens, event_tokens
from recollect.plans.checkpoints import cut

# Fixed values, at a budget of 1500 tokens.
SCALE, MANDATORY_LIMIT, COMPONENT_LIMIT, MOST_COMPONENTS = 1500.0, 500, 150, 5
MANDATORY_TYPES = ("CONSTRAINT_HARD", "APPROACH_ABANDONED_DO_NOT_RETRY")
AUTHORITY = {"user_stated": 3, "assistant_decided": 2, "llm": 2, "assistant_answer_to_user_question": 1, "inferred_from_code": 0}


def fits(items: Column, limit: Column) -> Column:
    """Ids chosen from sorted structs (…, cost, id): each that still fits is taken, one that doesn't is passed over."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def take(acc: Column, x: Column) -> Column:
        more = F.struct((acc["used"] + x["cost"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids"))
        return F.when(acc["used"] + x["cost"] <= limit, more).otherwise(acc)

    return F.aggregate(items, start, take)


def greedy_fill(events: DataFrame, budget: int, by: str = "project_id") -> DataFrame:
    """by, id, phase of the events that fill the budget.

    First what is mandatory (its types, and what users stated) within a third of the budget:
    all of it, or by authority and weight what fits, one at least.  Then up to five components,
    one per path, within a tenth.  Then the rest by weight, passing over what doesn't fit.

    Rows are dropped before they are gathered where they can't be chosen: of equal cost c, only
    the first limit / c can, as the next would no longer fit.  So what meets in one task is
    bounded by the budget, however many events a project has.
    """
    scale = max(budget, 1) / SCALE
    mandatory_limit, component_limit = int(MANDATORY_LIMIT * scale), int(COMPONENT_LIMIT * scale)
    cost = event_tokens(F.col("event_type"), F.col("description"), F.col("rationale"), F.col("path"), F.col("affected_files")).cast("long")
    own = events.where(~F.col("archived")).withColumn("cost", cost)
    own = own.withColumn("mandatory", F.col("event_type").isin(*MANDATORY_TYPES) | (F.coalesce("authority", F.lit("")) == "user_stated"))
    own = cut(own.select(by, "id", "event_type", "authority", "path", "weight", "cost", "mandatory"))  # read by every phase
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv])[F.coalesce("authority", F.lit(""))], F.lit(2))

    must = own.where("mandatory").withColumn("_rank", rank)
    total = must.groupBy(by).agg(F.sum("cost").alias("total"))
    must = must.join(total, by)
    all_in = must.where(F.col("total") <= mandatory_limit).select(by, "id", "cost")
    over = must.where((F.col("total") > mandatory_limit))
    best = over.groupBy(by).agg(F.max_by(F.struct("id", "cost"), F.struct("_rank", "weight", -F.col("id"))).alias("b"))
    order = F.struct((-F.col("_rank")).alias("a"), (-F.col("weight")).alias("w"), "id", "cost")
    picked = _pick(over.where(F.col("cost") <= mandatory_limit), order, mandatory_limit, by)
    forced = best.join(picked.select(by).distinct(), by, "left_anti").select(by, F.col("b.id").alias("id"), F.col("b.cost").alias("cost"))
    mandatory = all_in.unionByName(picked).unionByName(forced)

    parts = own.where("event_type = 'COMPONENT_STATUS' and not mandatory")
    per_path = parts.groupBy(by, F.coalesce("path", F.lit("")).alias("_p")).agg(F.max_by(F.struct("id", "cost", "weight"), F.struct("weight", -F.col("id"))).alias("e"))
    heavy = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("e.weight"), "e.id"))
    five = per_path.withColumn("_k", heavy).where(F.col("_k") <= MOST_COMPONENTS).select(by, "e.*")
    components = _pick(five, F.struct((-F.col("weight")).alias("w"), "id", "cost"), component_limit, by)

    chosen = cut(mandatory.withColumn("phase", F.lit("mandatory")).unionByName(components.withColumn("phase", F.lit("component"))))
    used = chosen.groupBy(by).agg(F.sum("cost").alias("_used"))
    rest = own.where("not mandatory").join(chosen.where("phase = 'component'").select(by, "id"), [by, "id"], "left_anti").join(used, by, "left")
    rest = rest.withColumn("_left", F.lit(budget) - F.coalesce("_used", F.lit(0))).where(F.col("cost") <= F.col("_left"))
    filled = _pick(rest, F.struct((-F.col("weight")).alias("w"), "id", "cost"), None, by, budget)
    return chosen.select(by, "id", "phase").unionByName(filled.select(by, "id").withColumn("phase", F.lit("filled")))


def _pick(rows: DataFrame, order: Column, limit: int | None, by: str, most: int = 0) -> DataFrame:
    """The rows that `fits` chooses in an order; limit None: what the column _left says, `most` at most."""
    room = F.lit(limit).cast("long") if limit is not None else F.col("_left").cast("long")
    place = F.row_number().over(Window.partitionBy(by, "cost").orderBy(order))
    bounded = rows.withColumn("_room", room).withColumn("_place", place).where((F.col("_place") <= (limit or most)) & (F.col("_place") * F.col("cost") <= F.col("_room")))
    groups = bounded.groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("items"), F.first("_room").alias("room"))
    chosen = groups.select(by, "items", fits(F.col("items"), F.col("room"))["ids"].alias("ids"))
    each = chosen.select(by, F.explode(F.filter("items", lambda x: F.array_contains(F.col("ids"), x["id"]))).alias("x"))
    return each.select(by, F.col("x.id").alias("id"), F.col("x.cost").alias("cost"))


def section_caps(caps: dict[str, int], budget: int) -> dict[str, int]:
    """Section caps given for 1500 tokens, for another budget; one token at least."""
    return {name: max(1, int(cap * budget / SCALE)) for name, cap in caps.items()}


def within_cap(lines: DataFrame, cap: int, header: str, by: str = "project_id") -> DataFrame:
    """Lines (by, id, weight, line) of a section: the lightest go until the rest fits the cap, the last one stays."""
    heavy = Window.partitionBy(by).orderBy(F.desc("weight"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    length = F.sum(F.char_length("line") + 1).over(heavy) + len(header)
    tokens = F.greatest(F.lit(1), F.floor(length / 4))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("weight"), F.desc("id")))
    return lines.withColumn("_t", tokens).withColumn("_k", place).where((F.col("_t") <= cap) | (F.col("_k") == 1)).drop("_t", "_k")


def _joined(rows: DataFrame, order: Column, line: Column, header: str, name: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line"))))
    return rows.groupBy("project_id").agg(F.concat(F.lit(header + "\n"), F.array_join(F.transform(items, lambda x: x["line"]), "\n")).alias(name))


def _with_reason(description: Column, rationale: Column, between: str) -> Column:
    return F.concat(F.coalesce(description, F.lit("")), F.when(F.coalesce(rationale, F.lit("")) != "", F.concat(F.lit(between), rationale)).otherwise(""))


def rendered(records: DataFrame, headers: DataFrame) -> DataFrame:
    """project_id, block: the sections of records (with `section` and `place`) in their order, empty ones left out.

    headers: project_id, header.  Hard constraints and dead ends are sorted by hash, so that
    the block's beginning stays the same while they do.
    """
    times = F.when(F.coalesce("provenance_count", F.lit(1)) > 1, F.format_string(" (×%d)", "provenance_count")).otherwise("")
    history = F.array_join(F.transform("lineage", lambda x: F.concat(F.lit("\n  — previously: "), x["description"])), "")
    fact = F.concat(_with_reason(F.col("description"), F.col("rationale"), " — "), times)
    own = lambda name: records.where(F.col("section") == name)
    hard = _joined(own("hard"), F.col("content_hash"), F.concat(F.lit("- "), fact, history), "### Hard constraints — never violate", "s1")
    thread = own("thread").where("place = 1").select("project_id", F.concat(F.lit("### Active thread\nWorking on: "), F.coalesce("description", F.lit(""))).alias("s2"))
    waiting = own("pending").where("description <> ''")
    waiting = _joined(waiting, F.col("content_hash"), F.concat(F.lit("- "), F.col("description"), F.lit(" (assistant, session "), F.substring("session_id", 1, 12), F.lit(")")), "### Pending confirmation", "s3")
    dead = _joined(own("graveyard"), F.col("content_hash"), F.concat(F.lit("- "), _with_reason(F.col("description"), F.col("rationale"), " -> ")), "### Do not retry — confirmed failures", "s4")
    state = F.concat(F.lit("- "), F.col("path"), F.lit(" · "), F.upper(F.coalesce("status", F.lit("modified"))), F.when(F.coalesce("intent", F.lit("")) != "", F.concat(F.lit(" — "), F.col("intent"))).otherwise(""))
    parts = _joined(own("component"), F.col("place"), state, "### Component state", "s5")
    decided = _joined(own("decision"), F.col("place"), F.concat(F.col("place").cast("string"), F.lit(". "), fact, F.lit(" (session "), F.col("session_id"), F.lit(")"), history), "### Key decisions", "s6")
    out = headers
    for part in (hard, thread, waiting, dead, parts, decided, summaries(records)):
        out = out.join(part, "project_id", "left")
    return out.select("project_id", F.concat_ws("\n\n", "header", "s1", "s2", "s3", "s4", "s5", "s6", "s7").alias("block"))


def summaries(records: DataFrame) -> DataFrame:
    """project_id, s7: languages by file names, the current thread, the first file in flux."""
    language = (
        F.when(F.col("path").rlike(r"\.tsx?$"), "TypeScript").when(F.col("path").endswith(".py"), "Python").when(F.col("path").rlike(r"\.(?:js|jsx|mjs)$"), "JavaScript").when(F.col("path").endswith(".go"), "Go").when(F.col("path").endswith(".rs"), "Rust")
    )
    part = F.col("section") == "component"
    found = records.groupBy("project_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(part, language))), "/").alias("languages"),
        F.max(F.coalesce(part & F.col("path").rlike(r"(?:^|/)package\.json$"), F.lit(False))).alias("node"),
        F.min_by("description", F.when(F.col("section") == "thread", F.col("place"))).alias("thread"),
        F.min_by("path", F.when(part & (F.col("status") == "in_flux"), F.col("place"))).alias("flux"),
    )
    kind = F.concat_ws("/", F.nullif("languages", F.lit("")), F.when(F.col("node"), "Node"))
    said = F.concat_ws(" ", F.when(kind != "", F.concat(kind, F.lit(" project."))), F.when(F.coalesce("thread", F.lit("")) != "", F.format_string("Currently %s.", "thread")), F.when(F.col("flux").isNotNull(), F.format_string("Do not ship until %s is stable.", "flux")))
    return found.select("project_id", F.concat(F.lit("### Summary\n"), F.coalesce(F.nullif(said, F.lit("")), F.lit("Project state is being established."))).alias("s7"))


def block_or_message(blocks: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, text for projects (project_id, n_records, damaged): the block, or why there is none."""
    j = projects.join(blocks, "project_id", "left")
    text = (
        F.when(F.col("damaged"), "Session state could not be loaded due to a storage error.")
        .when(F.col("n_records").isNull(), "Memory is not initialized for this project.")
        .when(F.col("n_records") == 0, "This is the first session for this project. State will accumulate as you work.")
        .otherwise(F.col("block"))
    )
    return j.select("project_id", text.alias("text"))


def block_tokens(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("tokens", count_tokens(F.col("block")))
