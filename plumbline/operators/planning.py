"""Fix plans for a table of validations.

Each validation has a handful of candidates (bounded by the template table), kept in one array
per validation; selection and ordering are array expressions on that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CRITICAL, HIGH, MEDIUM, LOW = 1, 2, 3, 4
FAILING = 65.0

# Fixes per failing dimension (dimension, title, category, impact, hours, dollars).
TEMPLATES = [
    ("distribution_fidelity", "Advanced Data Augmentation", "data_augmentation", 15.0, 12.0, 300.0),
    ("correlation_preservation", "Copula-Based Generation", "feature_engineering", 12.0, 16.0, 400.0),
]
# Candidates that do not come from a template.
GENERAL = {
    "loc_001": {"title": "Remove Problematic Data Samples", "category": "data_cleaning", "effort_hours": 2.0, "dollar_cost": 50.0, "gpu_hours": 0.5,
                "feasibility": 1.0, "complexity": 0.1, "novelty": 0.1, "days": 0.5},
    "crit_001": {"title": "CRITICAL: Full Dataset Regeneration", "category": "dataset_regeneration", "effort_hours": 80.0, "dollar_cost": 5000.0, "gpu_hours": 100.0,
                 "feasibility": 0.7, "complexity": 0.8, "novelty": 0.3, "days": 14.0},
    "div_001": {"title": "Enhance Dataset Diversity", "category": "data_augmentation", "effort_hours": 16.0, "dollar_cost": 400.0, "gpu_hours": 10.0,
                "feasibility": 0.9, "complexity": 0.4, "novelty": 0.2, "days": 3.0},
}
# How much more a fix gives when another one was taken before it.
SYNERGIES = {"div_001": {"dist_001": 1.2, "ent_001": 1.15}}


def template_table(spark: SparkSession, templates: list[tuple] | None = None) -> DataFrame:
    """Templates are data, so users add rows."""
    return spark.createDataFrame(
        templates or TEMPLATES, "dim_name string, title string, category string, base_impact double, effort_hours double, dollar_cost double")


FIELDS = ["validation_id", "rec_id", "title", "category", "priority", "impact", "effort_hours", "dollar_cost", "gpu_hours", "feasibility", "complexity", "novelty", "days",
          "dependencies", "incompatible", "synergies"]


def _links(df: DataFrame, rec_id: str | None = None) -> DataFrame:
    given = SYNERGIES.get(rec_id, {})
    pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(v))]
    none = F.array().cast("array<string>")
    return df.select("*", none.alias("dependencies"), none.alias("incompatible"), F.create_map(*pairs).cast("map<string,double>").alias("synergies")).select(*FIELDS)


LINK_KINDS = ("dependency", "exclusion", "synergy")


def link_table(spark: SparkSession, links: list[tuple]) -> DataFrame:
    """Links between fixes as rows ``(rec_id, other, kind, factor)``; the factor counts for synergies only."""
    for link in links:
        if link[2] not in LINK_KINDS:
            raise ValueError(f"unknown kind of link {link[2]}")
    return spark.createDataFrame(links, "rec_id string, other string, kind string, factor double")


def with_links(df: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates with the dependencies, exclusions and synergies of the link table; repeated links count once, the largest factor."""
    once = links.groupBy("rec_id", "other", "kind").agg(F.max("factor").alias("factor"))
    of = lambda kind, value: F.collect_list(F.when(F.col("kind") == kind, value))
    packed = once.groupBy("rec_id").agg(
        F.array_sort(of("dependency", F.col("other"))).alias("dependencies"), F.array_sort(of("exclusion", F.col("other"))).alias("incompatible"),
        F.map_from_entries(of("synergy", F.struct("other", "factor"))).alias("synergies"))
    none = F.array().cast("array<string>")
    # a fix has few ids, so a join by id would put most candidates into a few tasks; the link table is small by nature
    joined = df.drop("dependencies", "incompatible", "synergies").join(F.broadcast(packed), "rec_id", "left")
    return joined.withColumns({
        "dependencies": F.coalesce("dependencies", none), "incompatible": F.coalesce("incompatible", none),
        "synergies": F.coalesce("synergies", F.create_map().cast("map<string,double>"))}).select(*df.columns)


def link_states(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(validation_id, rec_id, open, satisfied, excluded)`` of every candidate against the chosen ones of its validation."""
    ids = chosen.groupBy("validation_id").agg(F.collect_set("rec_id").alias("ids"))  # as many as are chosen, a handful
    held = df.join(ids, "validation_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    missing = F.array_except("dependencies", "ids")
    return held.select("validation_id", "rec_id", missing.alias("open"), (F.size(missing) == 0).alias("satisfied"), F.arrays_overlap("incompatible", "ids").alias("excluded"))


def open_dependencies(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(validation_id, wants, rec_id)``: what a candidate needs and its validation did not choose."""
    return link_states(df, chosen).select("validation_id", F.col("rec_id").alias("wants"), F.explode("open").alias("rec_id"))


def execution_layers(plans: DataFrame) -> DataFrame:
    """``(validation_id, rec_id, layer)``: fixes of layer 0 need no other of the plan, those of layer n one of layer n - 1.

    Dependencies outside the plan do not count. What is on a cycle or needs something on one has no layer. The rounds
    are steps over a plan's own array, as many as it has fixes.
    """
    sel = F.col("selected")
    ids = F.transform(sel, lambda x: x["rec_id"])

    def step(done: Column, n: Column) -> Column:
        known = F.transform(done, lambda d: d["rec_id"])
        ready = F.filter(sel, lambda x: ~F.array_contains(known, x["rec_id"]) & (F.size(F.array_except(F.array_intersect(x["dependencies"], ids), known)) == 0))
        return F.concat(done, F.transform(ready, lambda x: F.struct(x["rec_id"].alias("rec_id"), n.alias("layer"))))

    rounds = F.when(F.size(sel) > 0, F.sequence(F.lit(0), F.size(sel) - 1)).otherwise(F.array().cast("array<int>"))
    start = F.array().cast("array<struct<rec_id:string,layer:int>>")
    layered = plans.withColumn("_done", F.aggregate(rounds, start, step)).withColumn("_id", F.explode(ids))
    return layered.select("validation_id", F.col("_id").alias("rec_id"), F.element_at(F.map_from_entries("_done"), F.col("_id")).alias("layer"))


def template_candidates(dims: DataFrame, templates: DataFrame) -> DataFrame:
    """One candidate per failing dimension and template; the worse the score, the larger the gain."""
    hit = dims.filter(F.col("score") < FAILING).join(F.broadcast(templates), "dim_name")  # the template table is small by nature
    return _links(hit.select(
        "validation_id", F.concat_ws("_", F.substring("dim_name", 1, 4), F.substring("title", 1, 4)).alias("rec_id"), "title", "category",
        F.when(F.col("score") < 50, HIGH).otherwise(MEDIUM).alias("priority"),
        (F.col("base_impact") * (1 + (65 - F.col("score")) / 100)).alias("impact"), "effort_hours", "dollar_cost", F.lit(5.0).alias("gpu_hours"),
        F.lit(0.85).alias("feasibility"), F.lit(0.5).alias("complexity"), F.lit(0.3).alias("novelty"), (F.col("effort_hours") / 8).alias("days")))


def _general(df: DataFrame, rec_id: str, priority: Column, impact: Column) -> DataFrame:
    g = GENERAL[rec_id]
    return _links(df.select("validation_id", F.lit(rec_id).alias("rec_id"), F.lit(g["title"]).alias("title"), F.lit(g["category"]).alias("category"),
                            priority.alias("priority"), impact.alias("impact"), *[F.lit(g[c]).alias(c) for c in FIELDS[6:13]]), rec_id)


def localization_candidates(runs: DataFrame) -> DataFrame:
    p = F.col("problem_percent")
    return _general(runs.filter(p > 5), "loc_001", F.when(p > 20, CRITICAL).otherwise(HIGH), F.least(F.lit(30.0), p * 1.5))


def critical_candidates(runs: DataFrame) -> DataFrame:
    return _general(runs.filter(F.col("collapse_score") < 30), "crit_001", F.lit(CRITICAL), F.lit(70.0))


def diversity_candidates(runs: DataFrame) -> DataFrame:
    return _general(runs.filter(F.col("diversity_score") < 60), "div_001", F.lit(HIGH), F.lit(15.0))


def candidates(runs: DataFrame, dims: DataFrame, templates: DataFrame) -> DataFrame:
    """All candidates with costs and the predicted range of their impact."""
    every = template_candidates(dims, templates).unionByName(localization_candidates(runs)).unionByName(critical_candidates(runs)).unionByName(diversity_candidates(runs))
    return with_impact(with_costs(every))


def with_costs(df: DataFrame) -> DataFrame:
    return df.withColumn("cost_usd", F.col("dollar_cost") + F.col("effort_hours") * 100 + F.col("gpu_hours") * 2)


def with_impact(df: DataFrame) -> DataFrame:
    """Heuristic range of 30 percent, its variance, success 0.8, return on cost and risk-adjusted impact."""
    i = F.col("impact")
    return (
        df.withColumn("impact_low", i * 0.7).withColumn("impact_high", i * 1.3)
        .withColumn("variance", F.pow((F.col("impact_high") - F.col("impact_low")) / 4, 2))
        .withColumn("success", F.lit(0.8))
        .withColumn("roi", i / F.greatest(F.lit(1.0), F.col("cost_usd")))
        .withColumn("risk_adjusted", i * F.col("success"))
    )


def success_probability(feasibility: Column, deviation: Column, complexity: Column, novelty: Column) -> Column:
    p = feasibility - F.least(F.lit(0.3), deviation / 20) - complexity * 0.2 - novelty * 0.15
    return F.greatest(F.lit(0.1), F.least(F.lit(0.99), p))


def within_limits(df: DataFrame, budget: Column | None = None, days: Column | None = None) -> DataFrame:
    """Candidates that fit alone; a missing or null limit is no limit."""
    if budget is not None:
        df = df.filter(budget.isNull() | (F.col("cost_usd") <= budget))
    if days is not None:
        df = df.filter(days.isNull() | (F.col("days") <= days))
    return df


def ranked(df: DataFrame, most: int) -> DataFrame:
    """Plain choice: priority, then impact."""
    w = Window.partitionBy("validation_id").orderBy("priority", F.col("impact").desc(), "rec_id")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


ITEM = ["rec_id", "priority", "impact", "variance", "success", "cost_usd", "effort_hours", "days", "risk_adjusted", "dependencies", "incompatible", "synergies"]
OBJECTIVES = ("max_impact", "min_cost", "balanced")


def objective(name: str) -> Column:
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective {name}")
    return {"max_impact": F.col("risk_adjusted"), "min_cost": -F.col("cost_usd"), "balanced": F.col("roi")}[name]


def greedy(df: DataFrame, goal: str = "balanced", budget: float | None = None, days: float | None = None, most: int = 10) -> DataFrame:
    """``(validation_id, selected)``: best first, skipping what breaks a limit, a dependency or an exclusion."""
    item = F.struct(*ITEM)
    pool = df.groupBy("validation_id").agg(F.collect_list(F.struct((-objective(goal)).alias("key"), F.col("rec_id").alias("id"), item.alias("item"))).alias("pool"))
    ordered = F.transform(
        F.array_sort("pool", lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)),
        lambda p: p["item"])
    start = F.struct(F.slice("ordered", 1, 0).alias("taken"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("days"))

    def step(acc: Column, x: Column) -> Column:
        ids = F.transform(acc["taken"], lambda t: t["rec_id"])
        cost, spent = acc["cost"] + x["cost_usd"], acc["days"] + x["days"]
        fits = (F.size(acc["taken"]) < most) & F.forall(x["dependencies"], lambda d: F.array_contains(ids, d)) & ~F.arrays_overlap(x["incompatible"], ids)
        if budget is not None:
            fits = fits & (cost <= budget)
        if days is not None:
            fits = fits & (spent <= days)
        return F.when(fits, F.struct(F.concat(acc["taken"], F.array(x)).alias("taken"), cost.alias("cost"), spent.alias("days"))).otherwise(acc)

    return pool.select("validation_id", ordered.alias("ordered")).select(
        "validation_id", F.aggregate("ordered", start, step)["taken"].alias("selected"))


def execution_order(plans: DataFrame) -> DataFrame:
    """Adds ``execution_order``: what depends on nothing open comes first, by priority, impact and synergy; cycles are left out."""
    sel = F.col("selected")
    ids = F.transform(sel, lambda x: x["rec_id"])

    def step(order: Column, _: Column) -> Column:
        def value(x: Column) -> Column:
            bonus = F.aggregate(order, F.lit(0.0), lambda s, done: s + F.coalesce(F.try_element_at(x["synergies"], done), F.lit(0.0)) * 50)
            return (5 - x["priority"]) * 100 + x["risk_adjusted"] + bonus

        open_items = F.filter(sel, lambda x: ~F.array_contains(order, x["rec_id"]) & F.forall(x["dependencies"], lambda d: ~F.array_contains(ids, d) | F.array_contains(order, d)))
        scored = F.transform(open_items, lambda x: F.struct((-value(x)).alias("v"), F.array_position(ids, x["rec_id"]).alias("p"), x["rec_id"].alias("id")))
        best = F.array_min(scored)
        return F.when(F.size(open_items) > 0, F.concat(order, F.array(best["id"]))).otherwise(order)

    start = F.slice(ids, 1, 0)
    return plans.withColumn("execution_order", F.when(F.size(sel) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(sel), F.lit(1))), start, step)))


def plan_totals(plans: DataFrame) -> DataFrame:
    """Impact with synergies, its bounds, joint success, cost, effort and duration with the parallel share taken off."""
    sel = F.col("selected")
    boosted = F.transform(sel, lambda x, i: x["impact"] * F.aggregate(F.slice(sel, F.lit(1), i), F.lit(1.0), lambda m, p: m * F.coalesce(F.try_element_at(x["synergies"], p["rec_id"]), F.lit(1.0))))
    total = lambda f: F.aggregate(sel, F.lit(0.0), lambda s, x: s + x[f])
    spread = 1.96 * F.sqrt(total("variance"))
    return plans.withColumn("total_impact", F.aggregate(boosted, F.lit(0.0), lambda s, x: s + x)).select(
        "*", F.greatest(F.lit(0.0), F.col("total_impact") - spread).alias("impact_low"), F.least(F.lit(100.0), F.col("total_impact") + spread).alias("impact_high"),
        F.aggregate(sel, F.lit(1.0), lambda s, x: s * x["success"]).alias("success"), total("cost_usd").alias("cost_usd"), total("effort_hours").alias("effort_hours"),
        (total("days") * 0.7).alias("days"))


def as_plans(chosen: DataFrame) -> DataFrame:
    """Ranked candidate rows back to one array per validation, in rank order."""
    packed = F.array_sort(F.collect_list(F.struct("place", F.struct(*ITEM).alias("item"))), lambda a, b: a["place"] - b["place"])
    return chosen.groupBy("validation_id").agg(packed.alias("p")).select("validation_id", F.transform("p", lambda x: x["item"]).alias("selected"))


def quick_wins(df: DataFrame) -> DataFrame:
    return df.filter((F.col("days") < 2) & (F.col("impact") > 10) & (F.col("feasibility") > 0.8))


def alternatives(df: DataFrame, main: DataFrame, goal: str = "balanced") -> DataFrame:
    """Totals of the plans other objectives would give, each with at most as many fixes as the main plan."""
    size = main.select("validation_id", F.size("selected").alias("n"))
    out = None
    for name in ("min_cost", "max_impact"):
        if name == goal:
            continue
        other = greedy(df, name, most=2**31 - 1).join(size, "validation_id").withColumn("selected", F.slice("selected", F.lit(1), F.col("n")))
        totals = plan_totals(other).filter(F.size("selected") > 0).select(
            "validation_id", F.lit(name).alias("objective"), F.size("selected").alias("fixes"), "total_impact", F.col("cost_usd").alias("total_cost"))
        out = totals if out is None else out.unionByName(totals)
    return out


def projected(score: Column, impact: Column) -> Column:
    return F.least(F.lit(100.0), score + impact)


def severity_band(score: Column) -> Column:
    return F.when(score < 30, "CRITICAL").when(score < 50, "SEVERE").when(score < 65, "MODERATE").otherwise("MINOR")


def summary(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per validation: fixes per priority, the strongest, the quickest and the best return; severity of the score."""
    count = lambda p: F.count_if(F.col("priority") == p)
    agg = chosen.groupBy("validation_id").agg(
        F.count("*").alias("fixes"), count(CRITICAL).alias("n_critical"), count(HIGH).alias("n_high"), count(MEDIUM).alias("n_medium"), count(LOW).alias("n_low"),
        F.min_by("rec_id", F.struct(-F.col("impact"), "rec_id")).alias("strongest"), F.min_by("rec_id", F.struct("days", "rec_id")).alias("quickest"),
        F.min_by("rec_id", F.struct(-F.col("roi"), "rec_id")).alias("best_return"), F.sum("impact").alias("impact"))
    out = runs.select("validation_id", "collapse_score").join(agg, "validation_id")
    return out.withColumn("severity", severity_band(F.col("collapse_score"))).withColumn("projected_score", projected(F.col("collapse_score"), F.col("impact"))).drop("impact")


def risk_assessment(chosen: DataFrame) -> DataFrame:
    """Per validation: hard, doubtful and novel fixes, joint success and the level of risk."""
    one = chosen.groupBy("validation_id").agg(
        F.count_if(F.col("complexity") > 0.7).alias("hard"), F.count_if(F.col("feasibility") < 0.6).alias("doubtful"), F.count_if(F.col("novelty") > 0.5).alias("novel"),
        F.product("success").alias("success"))
    return one.withColumn("level", F.when(F.col("success") > 0.8, "LOW").when(F.col("success") > 0.6, "MEDIUM").otherwise("HIGH"))


def combined_impact(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Score and level before and after each plan."""
    both = runs.select("validation_id", F.col("collapse_score").alias("before")).join(totals.select("validation_id", "total_impact"), "validation_id")
    return both.withColumn("after", projected(F.col("before"), F.col("total_impact"))).withColumn("band_before", severity_band(F.col("before"))).withColumn("band_after", severity_band(F.col("after")))
