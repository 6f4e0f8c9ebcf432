"""Plans of path changes before they are applied: which actions are approved, which are valid, and the ledger after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.functions import audit

#: Actions that a plan may have, and those that only report.
CHANGES = ("update_path_reference", "update_queue_reference")
REPORTS = ("mark_orphan_candidate", "investigate_duplicate_path", "mark_stale_processed_state_path")
RISKS = ("LOW", "REVIEW_REQUIRED")
#: Fields by which an approval may name an action, and those of its signature.
NAMING, SIGNATURE = ("action_id", "ledger_id", "action", "old_path", "new_path"), ("action", "old_path", "new_path", "queue_file")
LEDGER = ("ledger_id", "created_at", "operation_type", "status")


def filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def with_approval(plan: DataFrame, entries: DataFrame, items: DataFrame) -> DataFrame:
    """plan (key, approved, review_status and the fields of NAMING and SIGNATURE) with is_approved.

    An action is approved by its own mark or status; by an entry (the fields of NAMING) that agrees in every field that
    the action has; or by an approved item (signature, action_id, old_path, new_path, review_status) with its signature,
    its id, or both its paths. Each is an equi-join on distinct keys: an entry has a key for every set of its fields.
    Items and actions without an id don't meet by it.
    """
    sets = F.sequence(F.lit(0), F.lit((1 << len(NAMING)) - 1))

    def key_of(mask: Column) -> Column:
        parts = [F.when(mask.bitwiseAND(1 << k) != 0, F.to_json(F.array(c))) for k, c in enumerate(NAMING)]
        return F.concat_ws("|", mask.cast("string"), *parts)

    def possible(mask: Column) -> Column:
        return reduce(lambda a, b: a & b, [(mask.bitwiseAND(1 << k) == 0) | F.col(c).isNotNull() for k, c in enumerate(NAMING)])

    by_entry = entries.select(*NAMING).select(F.explode(F.transform(F.filter(sets, possible), key_of)).alias("__key")).distinct()
    good = items.where(F.lower("review_status") == "approved")
    keys = {
        "entry": (key_of(reduce(lambda a, b: a + b, [F.when(filled(c), 1 << k).otherwise(0) for k, c in enumerate(NAMING)])), by_entry),
        "signature": (F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in SIGNATURE]), good.select(F.col("signature").alias("__key")).distinct()),
        "id": (F.when(filled("action_id"), F.col("action_id")), good.where(filled("action_id")).select(F.col("action_id").alias("__key")).distinct()),
        "paths": (F.to_json(F.array("old_path", "new_path")), good.select(F.to_json(F.array("old_path", "new_path")).alias("__key")).distinct()),
    }
    rows = plan
    for name, (key, known) in keys.items():
        rows = rows.join(known.select(F.col("__key").alias(f"__{name}")), key == F.col(f"__{name}"), "left")
    own = F.coalesce(F.col("approved"), F.lit(False)) | (F.lower(F.coalesce("review_status", F.lit(""))) == "approved")
    met = reduce(lambda a, b: a | b, [F.col(f"__{name}").isNotNull() for name in keys])
    return rows.withColumn("is_approved", own | met).drop(*[f"__{name}" for name in keys])


def plain(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), "/+", "/")


def validated(plan: DataFrame, files: DataFrame, canonical: DataFrame, root: str) -> DataFrame:
    """plan with status (valid, invalid, skipped), reason, issues and warnings.

    plan has action, old_path, new_path, filepath, review_tier, risk, confidence (text), report_only, unresolved and
    is_approved; files (filepath) exist, canonical (path) are known. Reports are skipped; every fault is an issue, in
    fixed order, and the first is the reason. One pass over the plan with joins to distinct paths.
    """
    paths = files.select(F.col("filepath").alias("__p")).where("__p IS NOT NULL").distinct()
    known = canonical.select(F.col("path").alias("__p")).where("__p IS NOT NULL").distinct()
    rows = plan.select("*", *[F.trim(F.coalesce(c, F.lit(""))).alias(f"__{c}") for c in ("action", "old_path", "new_path", "review_tier", "risk")])
    for name, key, table in (("old_there", F.col("__old_path"), paths), ("new_there", F.col("__new_path"), paths), ("known", F.col("__old_path"), known), ("known_plain", plain(F.col("__old_path")), known)):
        rows = rows.join(table.select(F.col("__p").alias(f"__{name}")), F.when(key != "", key) == F.col(f"__{name}"), "left")
    action, old, new, tier, risk = (F.col(f"__{c}") for c in ("action", "old_path", "new_path", "review_tier", "risk"))
    outside = lambda p: (p != "") & ~(plain(p).startswith(root + "/") | (plain(p) == root))
    score, path, queue = F.col("confidence").try_cast("double"), action == CHANGES[0], action == CHANGES[1]
    open_ = F.coalesce("unresolved", F.lit(False)) | (new == "")
    tests = [
        (action == "", F.lit("missing_action_type")), ((action != "") & ~action.isin(*CHANGES, *REPORTS), F.concat(F.lit("unsupported_action_type:"), action)), (tier == audit.TIERS[2], F.lit("weak_match_rejected")),
        ((tier == audit.TIERS[1]) & ~risk.isin(*RISKS), F.concat(F.lit("invalid_risk_for_review_tier:"), F.coalesce(F.nullif(risk, F.lit("")), F.lit("missing")))),
        ((risk == RISKS[1]) & ~F.col("is_approved"), F.lit("review_required_not_approved")), ((path | queue) & (old == ""), F.lit("missing_old_path")), (path & (new == ""), F.lit("missing_new_path")),
        (path & (old != "") & F.col("__old_there").isNull(), F.lit("old_path_missing_on_disk")), (((path & (new != "")) | (queue & ~open_)) & F.col("__new_there").isNull(), F.lit("new_path_missing_on_disk")),
        ((old != "") & F.col("__known").isNull() & F.col("__known_plain").isNull(), F.lit("old_path_not_in_canonical_db")), (outside(old), F.lit("old_path_outside_root")), (outside(new), F.lit("new_path_outside_root")),
        (F.col("confidence").isNotNull() & score.isNull(), F.lit("confidence_not_numeric")), (score.isNotNull() & ~score.between(0, 1), F.lit("confidence_out_of_range")),
    ]
    notes = [
        (queue & open_, F.lit("queue_reference_unresolved")), ((tier != "") & ~tier.isin(*audit.TIERS), F.concat(F.lit("unexpected_review_tier:"), tier)), ((risk != "") & ~risk.isin(*RISKS), F.concat(F.lit("unexpected_risk:"), risk)),
    ]
    skipped, none = action.isin(*REPORTS) | F.coalesce("report_only", F.lit(False)), F.array().cast("array<string>")
    listed = {name: F.when(skipped, none).otherwise(F.array_compact(F.array(*[F.when(t, said) for t, said in found]))).alias(name) for name, found in (("issues", tests), ("warnings", notes))}
    rows = rows.select(*plan.columns, skipped.alias("__skipped"), *listed.values())
    status = F.when(F.col("__skipped"), "skipped").when(F.size("issues") > 0, "invalid").otherwise("valid")
    reason = F.when(F.col("__skipped"), "report_only").otherwise(F.get("issues", F.lit(0)))
    return rows.select(*plan.columns, status.alias("status"), reason.alias("reason"), "issues", "warnings")


def ledger_issues(ledger: DataFrame, files: DataFrame, tables: str = "affected_tables") -> DataFrame:
    """(ledger rows, tables array, issues, ok): required fields, paths that are nowhere, tables and values that can't be read.

    files (filepath) are all files and folders that exist. Tables are a JSON list or text, or names between commas.
    """
    there = files.select(F.col("filepath").alias("__p")).where("__p IS NOT NULL").distinct()
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = ledger
    for c in ("root", "old_path", "new_path"):
        rows = rows.join(there.select(F.col("__p").alias(f"__{c}")), F.when(text(c) != "", text(c)) == F.col(f"__{c}"), "left")
    raw = text(tables)
    kind = F.schema_of_variant(F.try_parse_json(raw))
    named = lambda names: F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    listed = F.when(raw == "", F.array().cast("array<string>")).when(kind.startswith("ARRAY"), F.filter(F.from_json(raw, "array<string>"), lambda n: F.trim(n) != ""))
    listed = listed.when(kind == "STRING", F.array(F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0)))).when(kind.isNotNull(), F.array().cast("array<string>")).otherwise(named(F.split(raw, ",")))
    rows = rows.withColumns({"__raw": raw, "__kind": kind, "tables": listed})
    tests = [(text(c) == "", F.lit(f"missing_required_field:{c}")) for c in LEDGER]
    tests += [((text("root") != "") & F.col("__root").isNull(), F.concat(F.lit("missing_root_path:"), text("root")))]
    tests += [((text(c) != "") & F.col(f"__{c}").isNull(), F.concat(F.lit(f"missing_referenced_path:{c}:"), text(c))) for c in ("old_path", "new_path")]
    tests += [(F.col("__kind").isNotNull() & ~F.col("__kind").startswith("ARRAY") & (F.col("__kind") != "STRING") & (F.col("__raw") != ""), F.lit("affected_tables_not_list")), (F.col("__raw") == "", F.lit("missing_affected_tables"))]
    for c in ("before_values_json", "after_values_json"):
        tests += [(text(c) == "", F.lit(f"missing_{c}")), ((text(c) != "") & F.try_parse_json(text(c)).isNull(), F.lit(f"invalid_json:{c}"))]
    tests += [(F.size("tables") == 0, F.lit("empty_affected_tables"))]
    rows = rows.withColumn("issues", F.array_compact(F.array(*[F.when(t, said) for t, said in tests])))
    return rows.select(*ledger.columns, "tables", "issues", (F.size("issues") == 0).alias("ok"))
