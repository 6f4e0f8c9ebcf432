"""Queries of plan validation, approvals and ledgers with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshelf.operators import audit, reconcile
from lakeshelf.plans.catalogue import query
from lakeshelf.plans.parsing import each
from lakeshelf.plans.views import view

#: Approvals: entries that name an action by some of its fields, and items by signature, id or paths.
APPROVED = f"""+ e AS (SELECT action_id, CAST(NULL AS VARCHAR) AS ledger_id, CASE id % 2 WHEN 0 THEN action END AS action, CASE id % 4 WHEN 1 THEN NULL ELSE old_path END AS old_path, new_path FROM v_actions WHERE id % 14 = 0 OR id % 15 = 1),
  i AS (SELECT CASE id % 3 WHEN 1 THEN concat_ws('|', coalesce(action, ''), coalesce(old_path, ''), coalesce(new_path, ''), '') ELSE '-' END AS signature, action_id, CASE id % 3 WHEN 2 THEN old_path ELSE 'x' END AS old_path, new_path, CASE id % 2 WHEN 0 THEN 'APPROVED' ELSE 'rejected' END AS review_status FROM v_actions WHERE id % 10 = 0),
  ok AS (SELECT * FROM i WHERE lower(review_status) = 'approved'),
  a AS (SELECT *, approved OR lower(coalesce(review_status, '')) = 'approved' OR EXISTS (SELECT 1 FROM e WHERE {' AND '.join(f"(coalesce(v_actions.{c}, '') = '' OR e.{c} = v_actions.{c})" for c in reconcile.NAMING)})
    OR EXISTS (SELECT 1 FROM ok WHERE ok.signature = concat_ws('|', coalesce(v_actions.action, ''), coalesce(v_actions.old_path, ''), coalesce(v_actions.new_path, ''), '') OR (coalesce(ok.action_id, '') <> '' AND ok.action_id = v_actions.action_id) OR (ok.old_path IS NOT DISTINCT FROM v_actions.old_path AND ok.new_path IS NOT DISTINCT FROM v_actions.new_path)) AS is_approved FROM v_actions)"""


def approved(spark, sf_dir):
    rows = view(spark, sf_dir, "actions")
    entries = rows.where("id % 14 = 0 OR id % 15 = 1").selectExpr("action_id", "ledger_id", "CASE id % 2 WHEN 0 THEN action END AS action", "CASE id % 4 WHEN 1 THEN NULL ELSE old_path END AS old_path", "new_path")
    items = rows.where("id % 10 = 0").selectExpr(
        "CASE id % 3 WHEN 1 THEN concat_ws('|', coalesce(action, ''), coalesce(old_path, ''), coalesce(new_path, ''), '') ELSE '-' END AS signature", "action_id", "CASE id % 3 WHEN 2 THEN old_path ELSE 'x' END AS old_path", "new_path",
        "CASE id % 2 WHEN 0 THEN 'APPROVED' ELSE 'rejected' END AS review_status",
    )
    return reconcile.with_approval(rows, entries, items)


@query(f"{APPROVED} SELECT id, is_approved FROM a", "actions")
def approved_actions(spark, sf_dir):
    return approved(spark, sf_dir).select("id", "is_approved")


PLAIN = "regexp_replace(regexp_replace({0}, '/(?:\\./)+', '/', 'g'), '/+', '/', 'g')"
OUTSIDE = "{0} <> '' AND NOT starts_with(" + PLAIN + ", '/lib/') AND " + PLAIN + " <> '/lib'"
VALIDATED = f"""{APPROVED}, n AS (SELECT * EXCLUDE (action, old_path, new_path, review_tier, risk), trim(coalesce(action, '')) AS action, trim(coalesce(old_path, '')) AS old, trim(coalesce(new_path, '')) AS new, trim(coalesce(review_tier, '')) AS tier, trim(coalesce(risk, '')) AS risk FROM a),
  files AS (SELECT old_path AS p FROM v_actions WHERE id % 4 <> 0 UNION SELECT new_path FROM v_actions WHERE id % 3 <> 0), known AS (SELECT {PLAIN.format('old_path')} AS p FROM v_actions WHERE id % 19 <> 0),
  t AS (SELECT *, action = 'update_path_reference' AS path, action = 'update_queue_reference' AS queue, coalesce(unresolved, false) OR new = '' AS open, action IN ({each(reconcile.REPORTS)}) OR report_only AS skipped, try_cast(confidence AS DOUBLE) AS score,
    old IN (SELECT p FROM files WHERE p IS NOT NULL) AS old_there, new IN (SELECT p FROM files WHERE p IS NOT NULL) AS new_there, old IN (SELECT p FROM known WHERE p IS NOT NULL) OR {PLAIN.format('old')} IN (SELECT p FROM known WHERE p IS NOT NULL) AS known FROM n),
  w AS (SELECT *, list_filter([CASE WHEN action = '' THEN 'missing_action_type' END, CASE WHEN action NOT IN ('', {each(reconcile.CHANGES + reconcile.REPORTS)}) THEN 'unsupported_action_type:' || action END, CASE WHEN tier = 'WEAK_MATCH' THEN 'weak_match_rejected' END,
    CASE WHEN tier = 'REVIEW_CAREFULLY' AND risk NOT IN ('LOW', 'REVIEW_REQUIRED') THEN 'invalid_risk_for_review_tier:' || CASE WHEN risk = '' THEN 'missing' ELSE risk END END, CASE WHEN risk = 'REVIEW_REQUIRED' AND NOT is_approved THEN 'review_required_not_approved' END,
    CASE WHEN (path OR queue) AND old = '' THEN 'missing_old_path' END, CASE WHEN path AND new = '' THEN 'missing_new_path' END, CASE WHEN path AND old <> '' AND NOT old_there THEN 'old_path_missing_on_disk' END, CASE WHEN ((path AND new <> '') OR (queue AND NOT open)) AND NOT new_there THEN 'new_path_missing_on_disk' END,
    CASE WHEN old <> '' AND NOT known THEN 'old_path_not_in_canonical_db' END, CASE WHEN {OUTSIDE.format('old')} THEN 'old_path_outside_root' END, CASE WHEN {OUTSIDE.format('new')} THEN 'new_path_outside_root' END, CASE WHEN confidence IS NOT NULL AND score IS NULL THEN 'confidence_not_numeric' END,
    CASE WHEN score NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range' END], lambda x: x IS NOT NULL) AS iss, list_filter([CASE WHEN queue AND open THEN 'queue_reference_unresolved' END, CASE WHEN tier NOT IN ('', 'AUTO_SAFE_CANDIDATE', 'REVIEW_CAREFULLY', 'WEAK_MATCH') THEN 'unexpected_review_tier:' || tier END,
    CASE WHEN risk NOT IN ('', 'LOW', 'REVIEW_REQUIRED') THEN 'unexpected_risk:' || risk END], lambda x: x IS NOT NULL) AS war FROM t),
  v AS (SELECT id, CASE WHEN skipped THEN 'skipped' WHEN len(iss) > 0 THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN skipped THEN 'report_only' ELSE iss[1] END AS reason, CASE WHEN skipped THEN '' ELSE array_to_string(iss, ',') END AS issues, CASE WHEN skipped THEN '' ELSE array_to_string(war, ',') END AS warnings FROM w)"""


def validated(spark, sf_dir):
    rows = view(spark, sf_dir, "actions")
    files = rows.where("id % 4 <> 0").selectExpr("old_path AS filepath").unionByName(rows.where("id % 3 <> 0").selectExpr("new_path AS filepath"))
    canonical = audit.canonical_paths(rows.where("id % 19 <> 0").select(reconcile.plain(F.col("old_path")).alias("filepath")), root="/lib")
    return reconcile.validated(approved(spark, sf_dir), files, canonical, "/lib")


@query(f"{VALIDATED} SELECT * FROM v", "actions")
def validated_plan(spark, sf_dir):
    return validated(spark, sf_dir).select("id", "status", "reason", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"))


@query(f"{VALIDATED} SELECT status, reason, count(*) AS n FROM v GROUP BY 1, 2", "actions")
def validation_counts(spark, sf_dir):
    return validated(spark, sf_dir).groupBy("status", "reason").agg(F.count("*").alias("n"))


T = "trim(coalesce({0}, ''))"
RAW = T.format("affected_tables")
VERIFIED = f"""+ f AS (SELECT concat('/lib/', id) AS p FROM v_ledgers WHERE id % 4 <> 0 UNION SELECT '/lib'), k AS (SELECT *, CASE WHEN {RAW} <> '' AND json_valid({RAW}) THEN json_type(CAST({RAW} AS JSON)) END AS kind FROM v_ledgers),
  l AS (SELECT *, CASE WHEN kind = 'ARRAY' THEN list_filter(from_json(CAST({RAW} AS JSON), '["VARCHAR"]'), lambda x: trim(x) <> '') WHEN kind = 'VARCHAR' THEN [CAST({RAW} AS JSON) ->> '$'] WHEN kind IS NOT NULL THEN CAST([] AS VARCHAR[]) ELSE list_filter(list_transform(string_split({RAW}, ','), lambda x: trim(x)), lambda x: x <> '') END AS tables FROM k),
  w AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {T.format(c)} = '' THEN 'missing_required_field:{c}' END" for c in reconcile.LEDGER)}, CASE WHEN {T.format('root')} <> '' AND root NOT IN (SELECT p FROM f) THEN 'missing_root_path:' || root END,
    {', '.join(f"CASE WHEN {T.format(c)} <> '' AND {c} NOT IN (SELECT p FROM f) THEN 'missing_referenced_path:{c}:' || {c} END" for c in ('old_path', 'new_path'))}, CASE WHEN kind NOT IN ('ARRAY', 'VARCHAR') THEN 'affected_tables_not_list' END, CASE WHEN {RAW} = '' THEN 'missing_affected_tables' END,
    {', '.join(f"CASE WHEN {T.format(c)} = '' THEN 'missing_{c}' WHEN NOT json_valid({c}) THEN 'invalid_json:{c}' END" for c in ('before_values_json', 'after_values_json'))}, CASE WHEN len(tables) = 0 THEN 'empty_affected_tables' END], lambda x: x IS NOT NULL) AS iss FROM l)"""


@query(f"{VERIFIED} SELECT id, array_to_string(tables, ',') AS tables, array_to_string(iss, ',') AS issues, len(iss) = 0 AS ok FROM w", "ledgers")
def verified_ledger(spark, sf_dir):
    rows = view(spark, sf_dir, "ledgers")
    files = rows.where("id % 4 <> 0").select(F.concat(F.lit("/lib/"), F.col("id")).alias("filepath")).unionByName(spark.range(1).select(F.lit("/lib").alias("filepath")))
    return reconcile.ledger_issues(rows, files).select("id", F.array_join("tables", ",").alias("tables"), F.array_join("issues", ",").alias("issues"), "ok")
