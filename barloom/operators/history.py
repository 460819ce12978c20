"""Search candidates, research memory, lineage and audit tables."""
from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from barloom.operators.stats import flag_count
from barloom.operators.timeline import running

C = F.col
HOT = 200


def search_atoms(space: Mapping) -> list[dict]:
    """Conditions of a search space: values of categorical fields, operator x threshold of numeric ones."""
    atoms = []
    for f in space["fields"]:
        if "values" in f:
            atoms += [dict(field=f["field"], op="EQ", value=v) for v in f["values"]]
        else:
            atoms += [dict(field=f["field"], op=o, value=v) for o in f["operators"] for v in f["thresholds"]]
    return atoms


def generate_candidates(spark: SparkSession, search_atoms: Sequence[Mapping], *, max_conditions: int, grid: Mapping[str, Sequence[int]], search_id: str) -> DataFrame:
    """All combinations of 1..m atoms times the parameter grid, with a fingerprint id.

    Candidates are decoded from a distributed range: the grid by mixed radix, the
    combination by unranking, so neither the driver nor a join holds the product.
    """
    n_atoms = len(search_atoms)
    sizes = [math.comb(n_atoms, k) for k in range(1, min(max_conditions, n_atoms) + 1)]
    cells = math.prod(len(v) for v in grid.values())
    d = spark.range(sum(sizes) * cells).withColumn("_combo", F.floor(C("id") / F.lit(cells)).cast("long")).withColumn("_cell", C("id") % cells)
    radix = 1
    for name, values in reversed(list(grid.items())):
        pick = F.floor(C("_cell") / F.lit(radix)) % len(values)
        d = d.withColumn(name, F.element_at(F.array(*[F.lit(int(v)) for v in values]), (pick + 1).cast("int")))
        radix *= len(values)
    # combinatorial unranking: choose atoms one by one against cumulative binomials
    size, rest = F.lit(None).cast("int"), C("_combo")
    offset = 0
    for k, s in enumerate(sizes, 1):
        size = F.when((C("_combo") >= offset) & (C("_combo") < offset + s), k).otherwise(size)
        offset += s
    starts = [0, *itertools.accumulate(sizes)]
    d = d.withColumns({"conditions": size, "_left": C("_combo")})
    d = d.withColumn("_left", C("_combo") - F.element_at(F.array(*[F.lit(x) for x in starts]), C("conditions")))
    d = d.withColumns({"_prev": F.lit(-1), "atoms": F.array().cast("array<int>")})
    for step in range(len(sizes)):
        todo = C("conditions") > step
        need = C("conditions") - step - 1
        # ways with first atom a: comb(n-1-a, need); cumulative over a > prev
        ways = F.array(*[F.array(*[F.lit(math.comb(n_atoms - 1 - a, r)) for a in range(n_atoms)]) for r in range(len(sizes))])
        row = F.element_at(ways, need + 1)
        walk = F.aggregate(F.sequence(F.lit(0), F.lit(n_atoms - 1)), F.struct(C("_left").alias("left"), F.lit(-1).alias("pick")), lambda acc, a: F.when(
            (acc["pick"] >= 0) | (a <= C("_prev")), acc).when(acc["left"] < F.get(row, a), F.struct(acc["left"].alias("left"), a.alias("pick"))).otherwise(
            F.struct((acc["left"] - F.get(row, a)).alias("left"), F.lit(-1).alias("pick"))))
        d = d.withColumn("_w", F.when(todo, walk))
        d = d.withColumns({"atoms": F.when(todo, F.concat("atoms", F.array(C("_w.pick")))).otherwise(C("atoms")),
                           "_prev": F.when(todo, C("_w.pick")).otherwise(C("_prev")), "_left": F.when(todo, C("_w.left")).otherwise(C("_left"))})
    text = F.create_map(*[x for i, a in enumerate(search_atoms) for x in (F.lit(i), F.lit(f"{a['field']} {a['op']} {a['value']}"))])
    d = d.withColumn("condition", F.array_join(F.transform("atoms", lambda a: F.element_at(text, a)), " AND "))
    keys = list(grid)
    print_ = F.sha2(F.concat_ws("|", F.lit(search_id), C("condition"), *[C(k).cast("string") for k in keys]), 256)
    return d.select(F.concat(F.lit("CAND-"), F.upper(F.substring(print_, 1, 20))).alias("candidate_id"), print_.alias("fingerprint"),
                    "conditions", "atoms", "condition", *keys)


def true_atoms(events: DataFrame, atoms: Sequence[Mapping]) -> Column:
    """Array of the atom numbers that hold on a row."""
    from barloom.operators.labels import predicate
    return F.array_compact(F.array(*[F.when(predicate(a), F.lit(i)) for i, a in enumerate(atoms)]))


def evaluate_candidates(events: DataFrame, candidates: DataFrame, atoms: Sequence[Mapping], target: str, *, max_conditions: int,
                        minimum_sample: int = 30, minimum_effect: float = 0.0) -> DataFrame:
    """Sample size and mean target of every candidate over the whole event table, with a reason code.

    Events are first reduced to (set of true atoms) -> count, sum; the sets expand to the
    combinations they satisfy and meet candidates by equality, so work follows distinct
    atom sets instead of events x candidates.
    """
    y = C(f"`{target}`").cast("double")
    sets = events.filter(y.isNotNull()).groupBy(true_atoms(events, atoms).alias("on")).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    combos = F.transform("on", lambda a: F.array(a))
    level = combos
    for _ in range(1, max_conditions):
        level = F.flatten(F.transform(level, lambda c: F.transform(F.filter("on", lambda b: b > F.element_at(c, -1)), lambda b: F.concat(c, F.array(b)))))
        combos = F.concat(combos, level)
    hits = sets.select("n", "s", F.explode(combos).alias("atoms")).groupBy("atoms").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    j = candidates.join(hits, "atoms", "left").fillna(0, ["n"])
    mean = F.when(C("n") > 0, C("s") / C("n"))
    reason = (F.when(C("n") < minimum_sample, "REJECT_LOW_SAMPLE").when(mean < -minimum_effect, "REJECT_NEGATIVE_EFFECT")
              .when(mean <= minimum_effect, "REJECT_NO_EFFECT"))
    return j.withColumns({"mean_target": mean, "rejection_reason": reason, "verdict": F.when(reason.isNull(), "SURVIVES").otherwise("REJECTED")}).drop("s")


def memory_upsert(memory: DataFrame, incoming: DataFrame, *, id: str = "candidate_id", fingerprint: str = "fingerprint", content: str = "content") -> DataFrame:
    """Incoming rows classified NEW / NO_OP / CONFLICT / DUPLICATE_FINGERPRINT against memory and the batch itself.

    An id with several contents in the batch is a conflict in all its rows. Of the ids new to memory that share a fingerprint the smallest is
    NEW, the others are duplicates. Equal rows get equal actions; ``apply_upsert`` takes a repeated NEW row once.
    """
    m = memory.select(id, C(content).alias("_old"))
    known = memory.select(fingerprint).distinct().withColumn("_known", F.lit(True))
    own = incoming.groupBy(id).agg((F.min(content) != F.max(content)).alias("_split"))
    fresh = incoming.join(m.select(id), id, "left_anti").groupBy(fingerprint).agg(F.min(id).alias("_first"))
    j = incoming.join(own, id, "left").join(m, id, "left").join(known, fingerprint, "left").join(fresh, fingerprint, "left")
    action = (F.when(C("_split") | (C("_old") != C(content)), "CONFLICT").when(C("_old").isNotNull(), "NO_OP")
              .when(C("_known") | (C(id) != C("_first")), "DUPLICATE_FINGERPRINT").otherwise("NEW"))
    return j.select(*incoming.columns, action.alias("action"))


def apply_upsert(memory: DataFrame, classified: DataFrame) -> DataFrame:
    """Memory plus the NEW rows; a conflict fails the job."""
    fresh = classified.withColumn("_ok", F.when(C("action") == "CONFLICT", F.raise_error(F.lit("same id, different content"))).otherwise(C("action") == "NEW"))
    return memory.unionByName(fresh.filter("_ok").select(*memory.columns).distinct())


def children_of(memory: DataFrame, parent_id, parent: str = "parent_id", id: str = "candidate_id") -> DataFrame:
    return memory.filter(C(parent) == parent_id).orderBy(id)


def failure_summary(memory: DataFrame) -> DataFrame:
    return (memory.filter(C("verdict") == "REJECTED").groupBy("rejection_reason").agg(F.count("*").alias("candidates"))
            .orderBy(F.desc("candidates"), "rejection_reason"))


def memory_counts(memory: DataFrame) -> DataFrame:
    return memory.agg(F.count("*").alias("candidates"), flag_count(C("verdict") == "REJECTED").alias("rejected"), F.countDistinct("fingerprint").alias("fingerprints"))


def ancestry(edges: DataFrame, *, id: str = "id", parent: str = "parent_id", max_rounds: int = 40) -> DataFrame:
    """Root and depth of every node by pointer doubling: log2(depth) equi-joins, staged per round.

    Every round doubles the distance covered.  A node that still moves after 2^rounds steps
    lies on a cycle and fails the job.  Nodes at their root are joined no more; pointers travel by
    a shuffle, but for those of more than n / HOT nodes, which are fewer than HOT rows.
    """
    from barloom.sources.stage import stage
    d = stage(edges.select(C(id).alias("id"), F.coalesce(C(parent), C(id)).alias("up"), F.when(C(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"),
                           C(parent).isNotNull().alias("moved")))
    n = d.count()
    for i in range(max_rounds):
        active, nxt = d.filter("moved"), d.select(C("id").alias("up"), C("up").alias("_up2"), C("depth").alias("_d2"))
        often = stage(active.groupBy("up").count().filter(C("count") > n // HOT).select("up"))
        common = nxt.join(F.broadcast(often), "up", "left_semi")
        joined = (active.join(F.broadcast(often), "up", "left_semi").join(F.broadcast(common), "up", "left")
                  .unionByName(active.join(F.broadcast(often), "up", "left_anti").join(nxt.hint("merge"), "up", "left")))
        still = C("_up2").isNotNull() & (C("_up2") != C("up"))
        found = joined.select("id", F.coalesce("_up2", "up").alias("up"), (C("depth") + F.coalesce("_d2", F.lit(0))).alias("depth"), still.alias("moved"))
        d = stage(d.filter("NOT moved").unionByName(found))
        if d.filter("moved").isEmpty():
            return d.select("id", C("up").alias("root"), "depth")
        if 2 ** i > 2 * n:
            raise ValueError("cycle in ancestry")
    raise ValueError("ancestry deeper than allowed")


def search_burden(experiments: DataFrame, events: DataFrame, family: str = "family") -> DataFrame:
    """Experiments, hypotheses, result-driven and abandoned counts per family."""
    e = experiments.groupBy(family).agg(F.count("*").alias("experiments"), F.countDistinct("hypothesis").alias("hypotheses"),
                                        flag_count(C("change_reason") == "RESULT_DRIVEN").alias("result_driven"),
                                        flag_count(C("status").isin("CANCELLED", "FAILED")).alias("abandoned"))
    d = events.groupBy(family).agg(F.countDistinct("dataset").alias("datasets"))
    return e.join(d, family, "left").fillna(0, ["datasets"])


def flatten_specs(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    """(ids, path, value) leaves of JSON documents, dotted keys and [i] positions."""
    from barloom.functions.udtf import flatten_json_rows
    return flatten_json_rows(df, text, ids)


def repeated_parameters(leaves: DataFrame, family: str = "family", warning: int = 3, high: int = 6) -> DataFrame:
    """Parameters tried with several values inside a family."""
    g = leaves.groupBy(family, "path").agg(F.countDistinct("value").alias("values_tested"), F.countDistinct("spec_id").alias("specs"))
    return g.filter(C("values_tested") >= warning).withColumn("severity", F.when(C("values_tested") >= high, "HIGH").otherwise("WARNING"))


def flexibility_profile(leaves: DataFrame, spec: str = "spec_id") -> DataFrame:
    """Counts of parameters, thresholds, filters, windows and conditions per spec."""
    k = F.lower("path")
    has = lambda *words: flag_count(k.rlike("|".join(words)))
    return leaves.groupBy(spec).agg(F.count("*").alias("parameters"), has("threshold").alias("thresholds"),
                                    flag_count(k.rlike("filter|enabled") & C("value").isin("true", "false")).alias("boolean_filters"),
                                    has("optional", "condition").alias("conditions"), has("window", "time").alias("time_windows"))


def risk_score(findings: DataFrame, by: Sequence[str] = ("experiment",)) -> DataFrame:
    """min(100, 10 warnings + 25 highs) and the class: BLOCKED, HIGH_RISK, WARNING, SAFE."""
    g = findings.groupBy(*by).agg(flag_count(C("severity") == "WARNING").alias("warnings"), flag_count(C("severity") == "HIGH").alias("highs"),
                                  F.max(F.coalesce(C("hard_block"), F.lit(False)).cast("int")).alias("_hard"))
    g = g.withColumn("score", F.least(F.lit(100), 10 * C("warnings") + 25 * C("highs")))
    return g.withColumn("classification", F.when(C("_hard") == 1, "BLOCKED").when((C("highs") > 0) | (C("score") >= 50), "HIGH_RISK")
                        .when(C("warnings") > 0, "WARNING").otherwise("SAFE")).drop("_hard")


def role_conflicts(usage: DataFrame, dataset: str = "dataset", role: str = "role") -> DataFrame:
    """Datasets used under several roles; FINAL_AFTER_DISCOVERY when both occur."""
    g = usage.select(dataset, role).distinct().groupBy(dataset).agg(F.sort_array(F.collect_set(role)).alias("roles"))
    both = F.array_contains("roles", "FINAL_TEST") & F.array_contains("roles", "DISCOVERY")
    return g.filter(F.size("roles") > 1).select(dataset, F.array_join("roles", ",").alias("roles"), F.when(both, "FINAL_AFTER_DISCOVERY").otherwise("LABEL_CONFLICT").alias("conflict"))


def normalised_text(c) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), " +", " ")


def duplicate_text(df: DataFrame, text: str, id: str) -> DataFrame:
    """Texts equal after trim, lower-case and whitespace collapse; grouped by digest, never collected."""
    return (df.groupBy(F.sha2(normalised_text(C(text)), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(id).alias("first_id")).filter("copies > 1"))
