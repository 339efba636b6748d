"""Review queue, audit events and reviewers' decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfold.functions.names import md5_uuid


def priority(confidence: Column) -> Column:
    return F.when(confidence < 0.30, "high").when(confidence < 0.70, "medium").otherwise("low")


def _item(df: DataFrame, reason: str, key: str, level) -> DataFrame:
    item = F.concat_ws("|", F.lit(reason), F.col(key).cast("string"))
    return df.select(md5_uuid(item).alias("queue_item_id"), F.lit(reason).alias("reason"), F.col(key).cast("string").alias("subject"), level.alias("priority"), F.lit("pending").alias("status"))


def review_queue(classified: DataFrame, resolution: DataFrame, exposures: DataFrame, companies: DataFrame, unknown: str, *, unknown_limit: float = 1_000_000, company_limit: float = 500_000) -> DataFrame:
    """Items of five rules: low confidence, unclassifiable, unresolved, large unknown, large unclassified.

    `classified`: company_id, node_id, confidence; `resolution`: id, method; `exposures`: exposure_id, company_id,
    exposure, exposure_type; `companies`: company_id, primary_sector. An item's id follows from rule and subject.
    """
    known_node = F.col("node_id") != unknown
    low = _item(classified.filter(known_node & (F.col("confidence") < 0.70)), "low_confidence", "company_id", priority(F.col("confidence")))
    sectored = companies.filter("primary_sector is not null").select("company_id")
    none = classified.filter(~known_node).join(sectored, "company_id", "left_anti")
    unclassifiable = _item(none, "unclassifiable_company", "company_id", priority(F.coalesce("confidence", F.lit(0.0))))
    unresolved = _item(resolution.filter("method = 'unresolved'"), "unresolved_entity", "id", F.lit("high"))
    big = _item(exposures.filter((F.col("exposure_type") == "unknown") & (F.col("exposure") > unknown_limit)), "large_unknown_exposure", "exposure_id", F.lit("medium"))
    totals = exposures.filter("company_id is not null").groupBy("company_id").agg(F.sum("exposure").alias("total")).filter(F.col("total") > company_limit)
    open_companies = companies.filter("primary_sector is null").join(classified.select("company_id"), "company_id", "left_anti")
    large = _item(totals.join(open_companies, "company_id"), "large_unclassified_company", "company_id", F.lit("medium"))
    return low.unionByName(unclassifiable).unionByName(unresolved).unionByName(big).unionByName(large)


def decide(queue: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The queue after decisions (queue_item_id, status, resolved_by): resolved columns are set for every status."""
    d = decisions.select("queue_item_id", F.col("status").alias("new_"), "resolved_by")
    joined = queue.join(d, "queue_item_id", "left")
    return joined.select(
        "queue_item_id", "reason", "subject", "priority", F.coalesce("new_", "status").alias("status"), "resolved_by", F.when(F.col("new_").isNotNull(), now).alias("resolved_at")
    )


def audit_events(action: str, entity: str, df: DataFrame, key: str, actor: Column, payload: list[str]) -> DataFrame:
    """An event for each row; its id follows from action, entity and key, so that repeats can be told."""
    body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return df.select(
        md5_uuid(F.concat_ws("|", F.lit(action), F.lit(entity), F.col(key).cast("string"))).alias("audit_event_id"), F.lit(action).alias("action"), F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), actor.alias("actor"), body.alias("payload")
    )


def append_unseen(log: DataFrame, events: DataFrame) -> DataFrame:
    return log.unionByName(events.join(log.select("audit_event_id"), "audit_event_id", "left_anti"))


_EVENT = ["audit_event_id", "run_id", "actor_type", "actor", "action", "entity_type", "entity_id", "payload"]


def _events(run_id: str, action: str, entity: str, df: DataFrame, key: Column, actor: Column, payload: dict[str, Column], actor_type: str = "system") -> DataFrame:
    """An event for each row, with an id that follows from run, action and entity, so that a run told twice adds nothing."""
    body = F.to_json(F.struct(*[v.alias(k) for k, v in payload.items()]), {"ignoreNullFields": "false"})
    name = F.concat_ws("|", F.lit(run_id), F.lit(action), F.lit(entity), key.cast("string"))
    values = [md5_uuid(name), F.lit(run_id), F.lit(actor_type), actor, F.lit(action), F.lit(entity), key.cast("string"), body]
    return df.select(*[v.alias(c) for v, c in zip(values, _EVENT)])


def audit_trail(run_id: str, classified: DataFrame, queue: DataFrame, resolution: DataFrame, exposures: DataFrame) -> DataFrame:
    """The events of a run: one for each classification, review item and resolved name, and one for the run with its counts.

    `classified`: classification_id, company_id, model, taxonomy_type, node_id, confidence, rationale; `queue`:
    queue_item_id, reason, priority; `resolution`: id, method, confidence, company_id. A classification without a company
    goes by its own id. A run without exposures has no event of its own.
    """
    told = {"taxonomy_type": F.col("taxonomy_type"), "node_name": F.col("node_id"), "confidence": F.col("confidence"), "rationale": F.col("rationale")}
    found = _events(run_id, "ai_classification", "company", classified, F.coalesce(F.col("company_id").cast("string"), "classification_id"), F.coalesce("model", F.lit("unknown_model")), told)
    items = _events(run_id, "review_queue_insert", "review_queue_item", queue, F.col("queue_item_id"), F.lit("review_queue_generator"), {"reason": F.col("reason"), "priority": F.col("priority")})
    how = {"match_method": F.col("method"), "match_confidence": F.col("confidence"), "matched_company_id": F.col("company_id").cast("string")}
    names = _events(run_id, "entity_resolution", "holding", resolution, F.col("id"), F.lit("entity_resolver"), how)
    counts = None
    for label, df in (("classification_count", classified), ("review_queue_count", queue), ("entity_resolution_count", resolution), ("exposure_count", exposures)):
        one = df.agg(F.count("*").alias(label))
        counts = one if counts is None else counts.join(F.broadcast(one))  # a row each
    done = _events(run_id, "pipeline_run_complete", "pipeline", counts.filter("exposure_count > 0"), F.lit(run_id), F.lit("run_pipeline"), {c: F.col(c) for c in counts.columns})
    return found.unionByName(items).unionByName(names).unionByName(done)


def approvals(queue: DataFrame, decisions: DataFrame, companies: DataFrame) -> DataFrame:
    """The values that approved items write to their companies: company_id, queue_item_id, sector, industry, country,
    manual_override, approved_by. A reviewer's value wins over the provider's; items without a company or value have none.

    `queue`: queue_item_id, company_id, ai_sector, ai_industry, ai_country; `decisions`: queue_item_id, status,
    manual_sector, manual_industry, manual_country, resolved_by.
    """
    fields = ("sector", "industry", "country")
    empty_as_null = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = queue.join(decisions.filter("status = 'approved'"), "queue_item_id").join(companies.select("company_id"), "company_id", "left_semi")
    values = [F.coalesce(empty_as_null(f"manual_{f}"), empty_as_null(f"ai_{f}")).alias(f) for f in fields]
    manual = F.coalesce(*[empty_as_null(f"manual_{f}") for f in fields]).isNotNull()
    out = rows.select("company_id", "queue_item_id", *values, manual.alias("manual_override"), F.col("resolved_by").alias("approved_by"))
    return out.filter(F.coalesce(*fields).isNotNull())


def approval_events(run_id: str, approved: DataFrame) -> DataFrame:
    """An event for each approved item that changed a company, by its reviewer."""
    payload = {c: F.col(c) for c in ("company_id", "sector", "industry", "country", "manual_override", "approved_by", "queue_item_id")}
    events = _events(run_id, "review_queue_approve", "company", approved, F.col("queue_item_id"), F.col("approved_by"), payload, "user")
    return events.withColumn("entity_id", F.get_json_object("payload", "$.company_id"))


def change_events(run_id: str, entity: str, changes: DataFrame, key: str) -> DataFrame:
    """An event for each row-level change (change, key, before, after) of a stored table between two versions."""
    payload = {"before": F.col("before"), "after": F.col("after")}
    parts = [_events(run_id, f"row_{kind}", entity, changes.filter(F.col("change") == kind), F.col(key), F.lit("catalog"), payload) for kind in ("insert", "update", "delete")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
