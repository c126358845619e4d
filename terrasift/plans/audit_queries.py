"""Audit samples, sheets, precision, agreement and count validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions.stats import rounded
from terrasift.operators import audit as A
from terrasift.operators import components, ranking, spatial
from terrasift.plans.registry import query
from terrasift.plans.tables import Tables
from terrasift.schemas import AUDIT_SHEET, REFERENCE_COUNTS, require_columns
from terrasift.session import cut_lineage, scratch_dir


def _r(e: str, k: int = 6) -> str:
    return f"floor(({e}) * 1e{k} + 0.5) / 1e{k}"


def _wilson_sql(tp: str, n: str) -> tuple[str, str]:
    z = "1.96::DOUBLE"
    c = f"(({tp}::DOUBLE / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    s = f"({z} * sqrt({tp}::DOUBLE / {n} * (1 - {tp}::DOUBLE / {n}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n}))"
    return f"greatest(0, {c} - {s})", f"least(1, {c} + {s})"


_LO, _HI = _wilson_sql("tp", "n")
_COUNTS = "count(*) FILTER (label IN ('TP', 'FP')) AS n, count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label = 'FP') AS fp, count(*) FILTER (label = 'SKIP') AS skip"
_STATS = f"{_r('tp::DOUBLE / n')} AS precision, {_r(_LO)} AS ci_95_lower, {_r(_HI)} AS ci_95_upper"


def _sheet(t: Tables, rater: str = "a") -> DataFrame:
    return t.audit().withColumnRenamed(f"label_{rater}", "label")


def _six(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.expr(rounded(c, 6)) for c in ("precision", "ci_95_lower", "ci_95_upper")})


@query("precision_summary", f"SELECT n, tp, fp, skip, {_STATS} FROM (SELECT {_COUNTS} FROM (SELECT label_a AS label FROM audit))")
def summary(t: Tables) -> DataFrame:
    return _six(A.precision(_sheet(t)))


@query("precision_by_district_band", f"SELECT district, band, n, tp, fp, skip, CASE WHEN n > 0 THEN {_r('tp::DOUBLE / n')} END AS precision, CASE WHEN n > 0 THEN {_r(_LO)} END AS ci_95_lower, CASE WHEN n > 0 THEN {_r(_HI)} END AS ci_95_upper FROM (SELECT district, band, {_COUNTS} FROM (SELECT *, label_a AS label FROM audit) GROUP BY 1, 2)")
def by_band(t: Tables) -> DataFrame:
    return _six(A.precision(_sheet(t), ["district", "band"]))


_TERC = """q AS (SELECT quantile_cont(confidence, 1/3.0::DOUBLE) AS a, quantile_cont(confidence, 2/3.0::DOUBLE) AS b FROM audit),
tt AS (SELECT audit.*, CASE WHEN confidence <= a THEN 'low' WHEN confidence <= b THEN 'mid' ELSE 'high' END AS tercile FROM audit, q)"""


@query("precision_by_tercile", f"""WITH {_TERC}, c AS (SELECT coalesce(tercile, 'overall') AS tercile, count(*) AS n, count(*) FILTER (label_a = 'TP') AS tp FROM tt WHERE label_a <> 'SKIP' GROUP BY ROLLUP (tt.tercile))
SELECT tercile, n, tp, {_r('tp::DOUBLE / n', 3)} AS precision FROM c""")
def by_tercile(t: Tables) -> DataFrame:
    banded = ranking.value_terciles(_sheet(t), "confidence")
    return A.precision_by_tercile(banded).selectExpr("tercile", "n", "tp", f"{rounded('tp / n', 3)} AS precision")


@query("confidence_terciles", f"WITH {_TERC} SELECT doc_id, tercile FROM tt")
def terciles(t: Tables) -> DataFrame:
    return ranking.value_terciles(t.audit(), "confidence").select("doc_id", "tercile")


@query("terciles_within_district", """SELECT doc_id, CASE WHEN o <= 1 + (n - 1) * (1/3.0::DOUBLE) THEN 'low' WHEN o <= 1 + (n - 1) * (2/3.0::DOUBLE) THEN 'mid' ELSE 'high' END AS tercile
FROM (SELECT doc_id, row_number() OVER (PARTITION BY district ORDER BY confidence, doc_id) AS o, count(*) OVER (PARTITION BY district) AS n FROM audit)""")
def within(t: Tables) -> DataFrame:
    return ranking.terciles_within(t.audit(), "confidence", "doc_id", "district", "tercile").select("doc_id", "tercile")


@query("fixed_confidence_bands", "SELECT doc_id, band FROM audit")
def fixed_bands(t: Tables) -> DataFrame:
    return t.audit().drop("band").selectExpr("doc_id", f"{A.band_of('confidence')} AS band")


_POP = "SELECT band, count(*) AS population FROM (SELECT CASE WHEN confidence < 0.25 THEN 'low' WHEN confidence < 0.45 THEN 'mid' ELSE 'high' END AS band FROM sites) GROUP BY 1"


def _population(t: Tables) -> DataFrame:
    return t.sites().selectExpr(f"{A.band_of('confidence')} AS band").groupBy("band").agg(F.expr("count(1) AS population"))


@query("weighted_precision", f"""WITH pop AS ({_POP}), b AS (SELECT band, count(*) FILTER (label_a = 'TP') AS tp, count(*) FILTER (label_a <> 'SKIP') AS n FROM audit GROUP BY 1)
SELECT sum(population)::BIGINT AS population, {_r('sum(population * tp::DOUBLE / n) / sum(population)')} AS precision FROM pop JOIN b USING (band)""")
def weighted(t: Tables) -> DataFrame:
    return A.weighted_precision(_sheet(t), _population(t)).selectExpr("population", f"{rounded('precision', 6)} AS precision")


@query("bootstrap_interval")
def bootstrap(t: Tables) -> DataFrame:
    return A.bootstrap_interval(_sheet(t), _population(t))


@query("rater_agreement", f"""WITH p AS (SELECT count(*) AS n, avg((label_a = label_b)::INT) AS o FROM audit),
e AS (SELECT sum(a.c * b.c)::DOUBLE / ((SELECT n FROM p) * (SELECT n FROM p)) AS x FROM (SELECT label_a AS l, count(*) AS c FROM audit GROUP BY 1) a JOIN (SELECT label_b AS l, count(*) AS c FROM audit GROUP BY 1) b USING (l))
SELECT n, {_r('o')} AS percent_agreement, {_r('(o - x) / (1 - x)')} AS cohen_kappa FROM p, e""")
def agreement(t: Tables) -> DataFrame:
    return A.agreement(t.audit(), "label_a", "label_b").selectExpr("n", f"{rounded('percent_agreement', 6)} AS percent_agreement", f"{rounded('cohen_kappa', 6)} AS cohen_kappa")


def _responses(t: Tables) -> DataFrame:
    a = t.audit().selectExpr("doc_id", "district", "label_a AS label", "'A' AS sheet")
    return a.unionByName(t.audit().selectExpr("doc_id", "district", "label_b AS label", "'B' AS sheet"))


@query("rater_disagreements", 'SELECT doc_id, district, label_a AS "A", label_b AS "B" FROM audit WHERE label_a <> label_b')
def disagreements(t: Tables) -> DataFrame:
    return A.two_rater_pivot(_responses(t), ["doc_id", "district"]).filter("A <> B")


@query("sheets_concatenated", "SELECT sheet, label, count(*) AS n FROM (SELECT 'A' AS sheet, label_a AS label FROM audit UNION ALL SELECT 'B', label_b FROM audit) GROUP BY 1, 2")
def concatenated(t: Tables) -> DataFrame:
    return _responses(t).groupBy("sheet", "label").agg(F.expr("count(1) AS n"))


@query("first_response_per_item", "SELECT doc_id, label_a AS label, 'A' AS sheet FROM audit")
def first_response(t: Tables) -> DataFrame:
    return ranking.first_per_key(_responses(t), ["doc_id"], [F.col("sheet")]).select("doc_id", "label", "sheet")


@query("class_precision_small_samples", f"SELECT kiln_class, n, tp, fp, CASE WHEN n >= 10 THEN {_r('tp::DOUBLE / n')} END AS precision, CASE WHEN n < 10 THEN 'sample too small' END AS note FROM (SELECT kiln_class, {_COUNTS} FROM (SELECT *, label_a AS label FROM audit WHERE label_a <> 'SKIP') GROUP BY 1)")
def class_precision(t: Tables) -> DataFrame:
    return A.class_precision(_sheet(t), ["kiln_class"]).selectExpr("kiln_class", "n", "tp", "fp", f"{rounded('precision', 6)} AS precision", "note")


@query("cutoff_sweep", f"SELECT cutoff, n, tp, {_r('tp::DOUBLE / n')} AS precision FROM (SELECT cutoff, {_COUNTS} FROM (SELECT *, label_a AS label FROM audit) JOIN (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5]::DOUBLE[]) AS cutoff) ON confidence >= cutoff GROUP BY 1)")
def sweep(t: Tables) -> DataFrame:
    return A.cutoff_sweep(_sheet(t)).selectExpr("cutoff", "n", "tp", f"{rounded('precision', 6)} AS precision")


@query("earlier_round_summary_csv", f"""SELECT 'overall' AS metric, 'all' AS district, n, {_r('tp::DOUBLE / n', 4)} AS precision, NULL AS note FROM (SELECT {_COUNTS} FROM (SELECT label_a AS label FROM audit))
UNION ALL SELECT 'earlier_round_separate', 'all', n, {_r('tp::DOUBLE / n', 4)}, 'separate design; excluded from weighted estimate' FROM (SELECT {_COUNTS} FROM (SELECT label_b AS label FROM audit))""")
def earlier_round(t: Tables) -> DataFrame:
    now = A.precision(_sheet(t)).selectExpr("'overall' AS metric", "'all' AS district", "n", "precision")
    old = A.precision(_sheet(t, "b")).selectExpr("'earlier_round_separate' AS metric", "'all' AS district", "n", "precision", "'separate design; excluded from weighted estimate' AS note")
    rows = now.unionByName(old, allowMissingColumns=True).withColumn("precision", F.expr(rounded("precision", 4)))
    path = f"{scratch_dir(t.spark)}/audit_results"
    rows.write.mode("overwrite").csv(path, header=True)
    return t.spark.read.csv(path, header=True, schema="metric string, district string, n long, precision double, note string")


@query("audit_csv_scan", "SELECT doc_id::VARCHAR AS kiln_id, district, label_a AS label, kiln_class FROM audit")
def audit_csv(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/audit_sheet"
    t.audit().selectExpr("doc_id AS kiln_id", "district", "concat(' ', lower(label_a), ' ') AS label", "kiln_class").write.mode("overwrite").csv(path, header=True)
    sheet = require_columns(t.spark.read.schema(AUDIT_SHEET).csv(path, header=True), AUDIT_SHEET.names, "sheet")
    return A.guard_unique(A.normalise_labels(sheet), ["kiln_id", "district"], "sheet")


@query("population_from_markdown", "SELECT n_name AS district, band, count(*) AS population FROM (SELECT district AS n_name, CASE WHEN confidence < 0.25 THEN 'low' WHEN confidence < 0.45 THEN 'mid' ELSE 'high' END AS band FROM sites WHERE district IN ('NATION_1', 'NATION_2')) GROUP BY 1, 2")
def markdown(t: Tables) -> DataFrame:
    counts = t.sites().selectExpr("district", f"{A.band_of('confidence')} AS band").groupBy("district", "band").count()
    lines = counts.selectExpr("concat('| ', district, ' | ', band, ' | ', count, ' | 0 | 0 | x |') AS value")
    path = f"{scratch_dir(t.spark)}/population_md"
    lines.write.mode("overwrite").text(path)
    return A.population_table(t.spark.read.text(path), ("NATION_1", "NATION_2"))


@query("label_alias_map", "SELECT CASE label_a WHEN 'TP' THEN 'kiln' WHEN 'FP' THEN 'not_kiln' ELSE 'unsure' END AS label, count(*) AS n FROM audit GROUP BY 1")
def alias_map(t: Tables) -> DataFrame:
    return t.audit().selectExpr("CASE lower(label_a) WHEN 'tp' THEN 'kiln' WHEN 'fp' THEN 'not_kiln' ELSE 'unsure' END AS label").groupBy("label").agg(F.expr("count(1) AS n"))


@query("labels_normalised", "SELECT doc_id, label_a AS label FROM audit")
def normalised(t: Tables) -> DataFrame:
    return A.normalise_labels(t.audit().selectExpr("doc_id", "concat(' ', lower(label_a)) AS label"))


@query("audit_key_join", "SELECT doc_id, label_a AS label, band FROM audit")
def key_join(t: Tables) -> DataFrame:
    sheet = t.audit().selectExpr("doc_id", "label_a AS label")
    return A.join_key(sheet, t.audit().select("doc_id", "band"), ["doc_id"], "band")


@query("key_reconciliation", "SELECT doc_id, quality::INT AS quality, n_chars FROM labels JOIN documents USING (doc_id)")
def reconciled(t: Tables) -> DataFrame:
    labels = t.raw("labels").select("doc_id", "quality")
    docs = t.raw("documents").select("doc_id", "n_chars").join(labels, "doc_id", "left_semi")
    return A.reconcile(labels, docs, ["doc_id"])


@query("key_differences", "SELECT doc_id, 'right' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'left' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def differences(t: Tables) -> DataFrame:
    return A.key_differences(t.raw("labels"), t.raw("documents"), ["doc_id"])


@query("count_comparison", "SELECT district, coalesce(d, 0) AS detected, coalesce(reported_count, 0) AS reported, round(d::DOUBLE / nullif(reported_count, 0), 4) AS ratio FROM (SELECT district, count(*) AS d FROM sites GROUP BY 1) FULL JOIN reference_counts USING (district)")
def counts(t: Tables) -> DataFrame:
    return A.count_comparison(t.sites(), t.reference_counts())


@query("reference_count_csv", "SELECT district, reported_count FROM reference_counts")
def reference_csv(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/reference_counts"
    t.reference_counts().write.mode("overwrite").csv(path, header=True)
    return t.spark.read.schema(REFERENCE_COUNTS).csv(path, header=True)


@query("district_key_union", "SELECT district FROM sites UNION SELECT district FROM reference_counts")
def key_union(t: Tables) -> DataFrame:
    return t.sites().select("district").union(t.reference_counts().select("district")).distinct()


_MIX = "md5('42|' || kiln_id), kiln_id"


@query("tercile_stratified_sample", f"""WITH q AS (SELECT quantile_cont(confidence, 1/3.0::DOUBLE) AS a, quantile_cont(confidence, 2/3.0::DOUBLE) AS b FROM sites)
SELECT kiln_id, tercile FROM (SELECT *, row_number() OVER (PARTITION BY tercile ORDER BY {_MIX}) AS r FROM (SELECT kiln_id, CASE WHEN confidence <= a THEN 'low' WHEN confidence <= b THEN 'mid' ELSE 'high' END AS tercile FROM sites, q)) WHERE r <= 10""")
def stratified(t: Tables) -> DataFrame:
    banded = ranking.value_terciles(t.sites().select("kiln_id", "confidence"), "confidence")
    return ranking.sample_per_group(banded, "kiln_id", ["tercile"], 10).select("kiln_id", "tercile")


_SB = "SELECT *, CASE WHEN confidence < 0.25 THEN 'low' WHEN confidence < 0.45 THEN 'mid' ELSE 'high' END AS band FROM sites"


def _banded(t: Tables) -> DataFrame:
    return t.sites().selectExpr("kiln_id", "district", f"{A.band_of('confidence')} AS band")


def _targets(t: Tables) -> DataFrame:
    return t.raw("nation").selectExpr("n_name AS district", "explode(map('low', 5, 'mid', 4, 'high', 40)) AS (band, target)")


@query("targeted_sample", f"SELECT kiln_id, district, band FROM (SELECT *, row_number() OVER (PARTITION BY district, band ORDER BY {_MIX}) AS r FROM ({_SB})) WHERE r <= CASE band WHEN 'low' THEN 5 WHEN 'mid' THEN 4 ELSE 40 END")
def targeted(t: Tables) -> DataFrame:
    return A.sample_strata(_banded(t), "kiln_id", ["district", "band"], _targets(t))


@query("sample_shortfall", f"SELECT n_name AS district, v.band, target AS requested, least(target, coalesce(n, 0)) AS sampled, target - least(target, coalesce(n, 0)) AS shortfall FROM nation, (VALUES ('low', 5), ('mid', 4), ('high', 40)) v(band, target) LEFT JOIN (SELECT district, band, count(*) AS n FROM ({_SB}) GROUP BY 1, 2) c ON c.district = n_name AND c.band = v.band")
def shortfall(t: Tables) -> DataFrame:
    return A.shortfall(_banded(t), ["district", "band"], _targets(t))


_ALLOC = f"""a AS (SELECT district, band, count(*) AS size, count(*) * 20.0::DOUBLE / (SELECT count(*) FROM sites) AS raw FROM ({_SB}) GROUP BY 1, 2),
al AS (SELECT district, band, size, floor(raw)::BIGINT + CASE WHEN row_number() OVER (ORDER BY floor(raw) - raw, district, band) <= 20 - (SELECT sum(floor(raw)) FROM a) THEN 1 ELSE 0 END AS allocated FROM a)"""


@query("overlap_allocation", f"WITH {_ALLOC} SELECT district, band, size, allocated FROM al")
def allocation(t: Tables) -> DataFrame:
    return A.allocate(_banded(t), ["district", "band"], 20)


@query("sheet_assignment", f"SELECT kiln_id, CASE WHEN ov THEN 'A+B' WHEN r <= n // 2 THEN 'A' ELSE 'B' END AS assigned_sheet FROM (SELECT kiln_id, ov, row_number() OVER (PARTITION BY ov ORDER BY {_MIX}) AS r, count(*) OVER (PARTITION BY ov) AS n FROM (SELECT kiln_id, class = 'FCBK' AND confidence > 0.9 AS ov FROM sites))")
def sheets(t: Tables) -> DataFrame:
    df = t.sites().selectExpr("kiln_id", "class = 'FCBK' AND confidence > 0.9 AS is_overlap")
    return A.assign_sheets(df, "kiln_id", "is_overlap").select("kiln_id", "assigned_sheet")


_OLD = "old AS (SELECT kiln_id + 7 AS kiln_id, x + 20 AS x, y - 30 AS y FROM sites_xy WHERE confidence < 0.1)"


@query("exclude_already_labelled", f"WITH {_OLD} SELECT kiln_id FROM sites_xy s WHERE kiln_id NOT IN (SELECT kiln_id FROM old) AND NOT EXISTS (SELECT 1 FROM old o WHERE sqrt((s.x - o.x) * (s.x - o.x) + (s.y - o.y) * (s.y - o.y)) <= 50)")
def exclusions(t: Tables) -> DataFrame:
    sites = cut_lineage(t.sites_xy().select("kiln_id", "x", "y", "confidence"), "sites")
    old = sites.filter("confidence < 0.1").selectExpr("kiln_id + 7 AS kiln_id", "x + 20 AS x", "y - 30 AS y")
    fresh = sites.join(old.select("kiln_id"), "kiln_id", "left_anti")
    return spatial.within(fresh, old, "kiln_id", 50.0, how="left_anti").select("kiln_id")


def _crowd(t: Tables) -> DataFrame:
    """Two detections per site, a few metres apart."""
    two = t.sites_xy().selectExpr("explode(array(0, 1)) AS twin", "*")
    return cut_lineage(two.selectExpr("kiln_id * 2 + twin AS id", "district", "x + twin * 12 AS x", "y + twin * 9 AS y", "confidence - twin * 0.001D AS confidence"), "crowd")


@query("near_duplicate_components", """WITH RECURSIVE c AS (SELECT kiln_id * 2 + twin AS id, x + twin * 12 AS x, y + twin * 9 AS y FROM sites_xy, (VALUES (0), (1)) v(twin)),
e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 50),
r AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id, min(root) AS component FROM r GROUP BY 1""")
def duplicates(t: Tables) -> DataFrame:
    return components.near_duplicates(_crowd(t), "id", 50.0).select("id", "component")


@query("best_per_component")
def best_of(t: Tables) -> DataFrame:
    grouped = components.near_duplicates(_crowd(t), "id", 50.0)
    return components.best_of_component(grouped, "confidence", "id").select("id", "component", "confidence")


@query("eligibility_statistics")
def eligibility(t: Tables) -> DataFrame:
    grouped = components.near_duplicates(_crowd(t), "id", 50.0)
    groups = grouped.groupBy("district", "component").agg(F.expr("count(1) AS size"), F.expr("count_if(confidence >= 0.10) AS kept"))
    return groups.groupBy("district").agg(
        F.expr("sum(size) AS source_rows"), F.expr("sum(kept) AS confidence_rows"),
        F.expr("count_if(size > 1) AS near_duplicate_groups"), F.expr("sum(size - 1) AS near_duplicate_excess"),
    )
