"""Group K: search space, memory, lineage and audit tables."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import table
from barloom.operators import history as H, joins as J

C = F.col
# fixed values: a search space over lineitem columns
SPACE = dict(fields=[dict(field="l_returnflag", values=["A", "N", "R"]), dict(field="l_quantity", operators=["GT", "LTE"], thresholds=[10.0, 25.0, 40.0]),
                     dict(field="l_tax", operators=["GTE"], thresholds=[0.04])])
GRID = dict(left=[2, 3], right=[2], window=[4, 8])
ATOMS = [("l_returnflag EQ A", "l_returnflag = 'A'"), ("l_returnflag EQ N", "l_returnflag = 'N'"), ("l_returnflag EQ R", "l_returnflag = 'R'"), ("l_quantity GT 10.0", "l_quantity > 10"),
         ("l_quantity GT 25.0", "l_quantity > 25"), ("l_quantity GT 40.0", "l_quantity > 40"), ("l_quantity LTE 10.0", "l_quantity <= 10"), ("l_quantity LTE 25.0", "l_quantity <= 25"),
         ("l_quantity LTE 40.0", "l_quantity <= 40"), ("l_tax GTE 0.04", "l_tax >= 0.04")]
AT = "atm AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, (t, _) in enumerate(ATOMS)) + ") v(a, t))"
CO = f"{AT}, co AS (SELECT [a] AS atoms, t AS condition FROM atm UNION ALL SELECT [x.a, y.a], x.t || ' AND ' || y.t FROM atm x JOIN atm y ON x.a < y.a UNION ALL SELECT [x.a, y.a, z.a], x.t || ' AND ' || y.t || ' AND ' || z.t FROM atm x JOIN atm y ON x.a < y.a JOIN atm z ON y.a < z.a)"
CA = f"{CO}, ca AS (SELECT *, sha256('S1|' || condition || '|' || l.l || '|2|' || w.w) AS fingerprint, l.l AS \"left\", 2 AS \"right\", w.w AS \"window\" FROM co, (VALUES (2), (3)) l(l), (VALUES (4), (8)) w(w))"


def candidates(s):
    atoms = H.search_atoms(SPACE)
    return atoms, H.generate_candidates(s, atoms, max_conditions=3, grid=GRID, search_id="S1")


def memory(s, sf):
    """Orders as tested candidates: id, fingerprint by price step, verdict by status."""
    o = table(s, sf, "orders")
    return o.select(C("o_orderkey").alias("candidate_id"), F.floor(C("o_totalprice")).cast("string").alias("fingerprint"), C("o_orderpriority").alias("content"),
                    F.when(C("o_orderkey") > 0, F.floor(C("o_orderkey") / 2)).alias("parent_id"), F.when(C("o_orderstatus") == "P", "SURVIVES").otherwise("REJECTED").alias("verdict"),
                    F.when(C("o_orderstatus") != "P", C("o_orderpriority")).alias("rejection_reason"))


def specs(s, sf):
    e = table(s, sf, "events")
    return e.select(C("event_id").alias("spec_id"), C("event_type").alias("family"), "props")


def register(cat):
    @cat.add("k01_generate_candidates", f"WITH {CA}, n AS (SELECT count(*) AS n FROM orders) SELECT 'CAND-' || upper(substr(fingerprint, 1, 20)) AS candidate_id, condition, len(atoms) AS conditions, \"left\", \"right\", \"window\", n.n AS events FROM ca, n")
    def _(s, sf):
        n = table(s, sf, "orders").agg(F.count("*")).scalar()
        return candidates(s)[1].drop("fingerprint", "atoms").withColumn("events", n)

    @cat.add("k02_unseen_candidates", f"WITH {CA}, id AS (SELECT 'CAND-' || upper(substr(fingerprint, 1, 20)) AS candidate_id FROM ca) SELECT candidate_id FROM id WHERE candidate_id NOT IN (SELECT candidate_id FROM id JOIN orders ON ascii(substr(candidate_id, 6, 1)) % 5 = o_orderkey % 5 AND o_orderkey % 5 = 0)")
    def _(s, sf):
        c = candidates(s)[1]
        tried = table(s, sf, "orders").filter("o_orderkey % 5 = 0").select((C("o_orderkey") % 5).alias("k")).distinct()
        mem = c.withColumn("k", (F.ascii(F.substring("candidate_id", 6, 1)) % 5).cast("long")).join(tried, "k", "left_semi")
        return J.unseen(c.select("candidate_id"), mem)

    hit = " + ".join(f"CASE WHEN list_contains(atoms, {i}) AND NOT ({q}) THEN 1 ELSE 0 END" for i, (_, q) in enumerate(ATOMS))

    @cat.add("k03_evaluate_candidates", f"WITH {CO}, cb AS (SELECT {', '.join(f'({q}) AS q{i}' for i, (_, q) in enumerate(ATOMS))}, count(*) AS n, sum(0.05 - l_discount) AS s FROM lineitem GROUP BY ALL), ev AS (SELECT condition, sum(cb.n) AS n, sum(cb.s) AS s FROM co JOIN cb ON " + " AND ".join(f"(q{i} OR NOT list_contains(atoms, {i}))" for i in range(len(ATOMS)))
             + " GROUP BY 1) SELECT condition, l.l AS \"left\", w.w AS \"window\", coalesce(n, 0)::BIGINT AS n, round(s / n, 6) AS mean_target, CASE WHEN coalesce(n, 0) < 500 THEN 'REJECT_LOW_SAMPLE' WHEN s / n < -0.0003 THEN 'REJECT_NEGATIVE_EFFECT' WHEN s / n <= 0.0003 THEN 'REJECT_NO_EFFECT' END AS rejection_reason FROM co LEFT JOIN ev USING (condition), (VALUES (2), (3)) l(l), (VALUES (4), (8)) w(w)")
    def _(s, sf):
        atoms, c = candidates(s)
        e = table(s, sf, "lineitem").withColumn("y", F.lit(0.05) - C("l_discount"))
        d = H.evaluate_candidates(e, c, atoms, "y", max_conditions=3, minimum_sample=500, minimum_effect=0.0003)
        return d.select("condition", "left", "window", "n", "mean_target", "rejection_reason")

    MEM = "m AS (SELECT o_orderkey AS candidate_id, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS fingerprint, o_orderpriority AS content, CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS parent_id, CASE WHEN o_orderstatus = 'P' THEN 'SURVIVES' ELSE 'REJECTED' END AS verdict, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS rejection_reason FROM orders)"

    @cat.add("k04_memory_upsert", f"WITH {MEM}, old AS (SELECT * FROM m WHERE candidate_id % 3 <> 0), inc AS (SELECT candidate_id, fingerprint, CASE WHEN candidate_id % 7 = 0 THEN 'changed' ELSE content END AS content FROM m), p AS (SELECT DISTINCT fingerprint FROM old), fr AS (SELECT fingerprint, min(candidate_id) AS first FROM inc WHERE candidate_id NOT IN (SELECT candidate_id FROM old) GROUP BY 1) SELECT inc.candidate_id, CASE WHEN old.content IS NOT NULL THEN CASE WHEN old.content = inc.content THEN 'NO_OP' ELSE 'CONFLICT' END WHEN p.fingerprint IS NOT NULL OR inc.candidate_id <> fr.first THEN 'DUPLICATE_FINGERPRINT' ELSE 'NEW' END AS action FROM inc LEFT JOIN old USING (candidate_id) LEFT JOIN p ON p.fingerprint = inc.fingerprint LEFT JOIN fr ON fr.fingerprint = inc.fingerprint")
    def _(s, sf):
        m = memory(s, sf)
        inc = m.select("candidate_id", "fingerprint", F.when(C("candidate_id") % 7 == 0, "changed").otherwise(C("content")).alias("content"))
        return H.memory_upsert(m.filter("candidate_id % 3 <> 0"), inc).select("candidate_id", "action")

    @cat.add("k05_children_of", f"WITH {MEM} SELECT candidate_id, verdict FROM m WHERE parent_id = 12")
    def _(s, sf): return H.children_of(memory(s, sf), 12).select("candidate_id", "verdict")

    @cat.add("k05_failure_summary", f"WITH {MEM} SELECT rejection_reason, count(*) AS candidates FROM m WHERE verdict = 'REJECTED' GROUP BY 1")
    def _(s, sf): return H.failure_summary(memory(s, sf))

    @cat.add("k05_memory_counts", f"WITH {MEM} SELECT count(*) AS candidates, count(*) FILTER (verdict = 'REJECTED') AS rejected, count(DISTINCT fingerprint) AS fingerprints FROM m")
    def _(s, sf): return H.memory_counts(memory(s, sf))

    @cat.add("k06_ancestry", f"WITH RECURSIVE {MEM}, r AS (SELECT candidate_id AS id, candidate_id AS root, 0 AS depth FROM m WHERE parent_id IS NULL UNION ALL SELECT m.candidate_id, r.root, r.depth + 1 FROM m JOIN r ON m.parent_id = r.id) SELECT id, root, depth::BIGINT AS depth FROM r")
    def _(s, sf): return H.ancestry(memory(s, sf), id="candidate_id")

    LEAF = "l AS (SELECT event_id AS spec_id, event_type AS family, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events)"

    @cat.add("k07_repeated_parameters", f"WITH {LEAF} SELECT family, path, count(DISTINCT value) AS values_tested, count(DISTINCT spec_id) AS specs, CASE WHEN count(DISTINCT value) >= 6 THEN 'HIGH' ELSE 'WARNING' END AS severity FROM l GROUP BY 1, 2 HAVING count(DISTINCT value) >= 3")
    def _(s, sf): return H.repeated_parameters(H.flatten_specs(specs(s, sf), "props", ["spec_id", "family"]))

    @cat.add("d12_flatten_json", f"WITH {LEAF} SELECT spec_id, path, value FROM l")
    def _(s, sf): return H.flatten_specs(specs(s, sf), "props", ["spec_id"])

    @cat.add("k07_flexibility_profile", "SELECT o_orderkey AS spec_id, 4::BIGINT AS parameters, 1::BIGINT AS thresholds, (o_orderkey % 2)::BIGINT AS boolean_filters, 0::BIGINT AS conditions, 1::BIGINT AS time_windows FROM orders")
    def _(s, sf):
        item = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"))
        flag = F.when(C("o_orderkey") % 2 == 1, "true").otherwise("maybe")
        l = table(s, sf, "orders").select(C("o_orderkey").alias("spec_id"), F.explode(F.array(
            item("entry.threshold", C("o_totalprice").cast("string")), item("filter.enabled", flag), item("session.window", C("o_orderpriority")), item("name", C("o_orderstatus")))).alias("i"))
        return H.flexibility_profile(l.select("spec_id", "i.*"))

    @cat.add("k08_search_burden", "WITH e AS (SELECT o_orderpriority AS family, count(*) AS experiments, count(DISTINCT o_custkey) AS hypotheses, count(*) FILTER (o_orderkey % 6 = 0) AS result_driven, count(*) FILTER (o_orderstatus = 'F') AS abandoned FROM orders GROUP BY 1), d AS (SELECT o_orderpriority AS family, count(DISTINCT l_returnflag) AS datasets FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT family, experiments, hypotheses, result_driven, abandoned, coalesce(datasets, 0) AS datasets FROM e LEFT JOIN d USING (family)")
    def _(s, sf):
        o = table(s, sf, "orders")
        e = o.select(C("o_orderpriority").alias("family"), C("o_custkey").alias("hypothesis"), F.when(C("o_orderkey") % 6 == 0, "RESULT_DRIVEN").alias("change_reason"), F.when(C("o_orderstatus") == "F", "FAILED").alias("status"))
        ev = table(s, sf, "lineitem").join(o, C("l_orderkey") == C("o_orderkey")).select(C("o_orderpriority").alias("family"), C("l_returnflag").alias("dataset"))
        return H.search_burden(e, ev)

    @cat.add("k09_risk_score", "WITH f AS (SELECT o_custkey AS experiment, count(*) FILTER (o_orderstatus = 'F') AS w, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 400000) AS h, bool_or(o_totalprice > 499000) AS b FROM orders GROUP BY 1) SELECT experiment, w AS warnings, h AS highs, least(100, 10 * w + 25 * h) AS score, CASE WHEN b THEN 'BLOCKED' WHEN h > 0 OR 10 * w + 25 * h >= 50 THEN 'HIGH_RISK' WHEN w > 0 THEN 'WARNING' ELSE 'SAFE' END AS classification FROM f")
    def _(s, sf):
        f = table(s, sf, "orders").select(C("o_custkey").alias("experiment"), F.when(C("o_orderstatus") == "F", "WARNING").when((C("o_orderstatus") == "O") & (C("o_totalprice") > 400000), "HIGH").otherwise("INFO").alias("severity"), (C("o_totalprice") > 499000).alias("hard_block"))
        return H.risk_score(f)

    @cat.add("k10_exposure_check", "SELECT DISTINCT c_custkey AS lineage FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
    def _(s, sf):
        seen = table(s, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(C("o_custkey").alias("lineage"))
        return J.exposed(table(s, sf, "customer").select(C("c_custkey").alias("lineage")), seen, ["lineage"])

    @cat.add("k11_role_conflicts", "WITH u AS (SELECT DISTINCT l_suppkey AS dataset, CASE WHEN l_shipdate < TIMESTAMP '1995-04-01' THEN 'DISCOVERY' WHEN l_shipdate > TIMESTAMP '2001-07-01' THEN 'FINAL_TEST' ELSE 'VALIDATION' END AS role FROM lineitem), g AS (SELECT dataset, list_sort(list(role)) AS r FROM u GROUP BY 1) SELECT dataset, array_to_string(r, ',') AS roles, CASE WHEN list_contains(r, 'FINAL_TEST') AND list_contains(r, 'DISCOVERY') THEN 'FINAL_AFTER_DISCOVERY' ELSE 'LABEL_CONFLICT' END AS conflict FROM g WHERE len(r) > 1")
    def _(s, sf):
        role = F.when(C("l_shipdate") < "1995-04-01", "DISCOVERY").when(C("l_shipdate") > "2001-07-01", "FINAL_TEST").otherwise("VALIDATION")
        return H.role_conflicts(table(s, sf, "lineitem").select(C("l_suppkey").alias("dataset"), role.alias("role")))

    @cat.add("k12_duplicate_text", r"WITH n AS (SELECT doc_id, sha256(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' +', ' ', 'g')) AS digest FROM documents) SELECT digest, count(*) AS copies, min(doc_id) AS first_id FROM n GROUP BY 1 HAVING count(*) > 1")
    def _(s, sf): return H.duplicate_text(table(s, sf, "documents"), "text", "doc_id")
