"""Access rules, keys, names and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_admin(principal: Column) -> Column:
    return (principal == "admin") | principal.startswith("admin:")


def principal_type(principal: Column) -> Column:
    """What stands before the first colon; the whole text without one."""
    at = F.instr(principal, ":")
    return F.when(at > 0, F.substring_index(principal, ":", 1)).otherwise(principal)


def principal_name(principal: Column) -> Column:
    """What follows the first colon, or null."""
    at = F.instr(principal, ":")
    return F.when(at > 0, F.expr(f"substring({_sql(principal)}, instr({_sql(principal)}, ':') + 1)"))


def _sql(c: Column) -> str:
    return c._jc.toString()


def check_access(requests: DataFrame, acls: DataFrame) -> DataFrame:
    """Adds allowed to requests (request_id, principal, resource_type, resource, operation).

    Admins may do all. Else rules count in this order: a denial of the very resource, an allowance of it, a
    denial of all resources (*), an allowance of all; without any of them access is refused.
    """
    rule = acls.select("principal", "resource_type", F.col("resource_name").alias("_name"), F.col("operation").alias("_op"), "permission")
    hit = requests.join(rule, ["principal", "resource_type"], "left")
    applies = F.col("_op").isin("*") | (F.col("_op") == F.col("operation"))

    def any_rule(named: bool, permission: str) -> Column:
        place = F.col("_name") == F.col("resource") if named else F.col("_name") == "*"
        return F.coalesce(F.bool_or(applies & place & (F.col("permission") == permission)), F.lit(False))

    seen = hit.groupBy(*requests.columns).agg(any_rule(True, "deny").alias("sd"), any_rule(True, "allow").alias("sa"), any_rule(False, "deny").alias("wd"), any_rule(False, "allow").alias("wa"))
    verdict = F.when(is_admin(F.col("principal")), True).when(F.col("sd"), False).when(F.col("sa"), True).when(F.col("wd"), False).otherwise(F.col("wa"))
    return seen.select(*requests.columns, verdict.alias("allowed"))


def key_state(keys: DataFrame, now: Column) -> DataFrame:
    """Adds key_id (of tb_<32 hex digits>_<secret>) and state: invalid, revoked, expired or valid."""
    ident = F.regexp_extract("api_key", r"^tb_([0-9a-f]{32})_(.+)$", 1)
    state = F.when(ident == "", "invalid").when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= now, "expired").otherwise("valid")
    return keys.withColumn("key_id", ident).withColumn("state", state)


def resolve_topics(names: DataFrame, topics: DataFrame, given: str = "given") -> DataFrame:
    """Adds topic_id: a number stands for itself, a name is looked up; null if there is none."""
    found = names.join(topics.select(F.col("name").alias(given), F.col("topic_id").alias("_by_name")), given, "left")
    return found.select(*names.columns, F.coalesce(F.expr(f"try_cast({given} AS BIGINT)"), F.col("_by_name").cast("bigint")).alias("topic_id"))


def retained(index: DataFrame, topics: DataFrame, now: Column) -> DataFrame:
    """Segments that are within their topic's retention_hours."""
    limit = now - F.make_dt_interval(hours="retention_hours")
    return index.join(topics.select("topic", "retention_hours"), "topic").filter(F.col("ingest_time") >= limit).drop("retention_hours")


def latest_schema(links: DataFrame, schemas: DataFrame, topic: str = "topic") -> DataFrame:
    """Each topic's newest schema."""
    top = links.groupBy(topic).agg(F.max_by("schema_id", F.struct("created_at", "schema_id")).alias("schema_id"))
    return top.join(schemas, "schema_id")


def upsert_acls(acls: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules after changes: a rule for the same principal, resource and operation takes the new permission."""
    key = ["principal", "resource_type", "resource_name", "operation"]
    return acls.join(changes.select(*key), key, "left_anti").unionByName(changes.select(*key, "permission"))


def list_acls(acls: DataFrame, principal: str | None = None, resource_type: str | None = None) -> DataFrame:
    """Rules, narrowed by what is given."""
    for column, value in (("principal", principal), ("resource_type", resource_type)):
        if value is not None:
            acls = acls.filter(F.col(column) == value)
    return acls


def revoke_keys(keys: DataFrame, revoked: DataFrame, now: Column) -> DataFrame:
    """Keys after some key_ids were revoked; an earlier revocation stays as it is."""
    hit = revoked.select("key_id").distinct().withColumn("_hit", F.lit(True))
    return keys.join(hit, "key_id", "left").withColumn("revoked_at", F.coalesce("revoked_at", F.when(F.col("_hit"), now))).drop("_hit")
