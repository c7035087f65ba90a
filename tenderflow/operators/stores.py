"""Which stores have a smart safe, from configuration pushes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.codes import Codes
from tenderflow.functions import scope_store


def newest_pushes(tables: Mapping[str, DataFrame], codes: Codes) -> DataFrame:
    """Per configuration element and scope its highest version, and whether that enables a safe.

    Only "is the text switched on at the highest version" is needed, and a tie counts as on if
    any of its rows is.  That is the maximum of (version, on) per configuration element and
    scope, so the large configuration texts are never shuffled or joined back.
    """
    element = ["profile_group_id", "profile_element_id", "config_version"]
    changes = (
        tables["cfg_profile_element_changes"]
        .filter(F.col("change_type") == codes.change_type)
        .filter(F.col("change_subtype") == codes.change_subtype)
        .filter(F.col("organization_id").isNotNull())
        .select(
            "organization_id", *element,
            F.coalesce(F.col("changes").contains(codes.safe_enabled), F.lit(False)).alias("on"),
        )
    )
    deployments = (
        tables["dpl_deployment"]
        .filter(F.col("deployment_type") == codes.deployment_type)
        .filter(F.col("deploy_status").isin(*codes.deploy_statuses))
        .select(*element, "org_scope")
    )
    key = ["organization_id", "profile_group_id", "profile_element_id", "org_scope"]
    return (
        changes.join(deployments, element)
        .groupBy(*key).agg(F.max(F.struct("config_version", "on")).alias("newest"))
        .select(*key, "newest.*")
    )


def eligible_stores(tables: Mapping[str, DataFrame], codes: Codes | None = None) -> DataFrame:
    """Store numbers (as text, possibly the every-store mark) whose newest push enables a safe."""
    codes = codes or Codes()
    newest = newest_pushes(tables, codes).filter("on")
    members = tables["loc_rtl_loc_collection_element"].select("collection_name", "org_scope_code")
    scope = F.coalesce("org_scope_code", "org_scope")
    return (
        newest.join(members, F.col("org_scope") == F.col("collection_name"), "left")
        .select(scope_store(scope, codes).alias("rtl_loc_id"))
        .distinct()
    )


def by_eligibility(
    df: DataFrame, eligible: DataFrame, wanted: bool, codes: Codes, store: str = "rtl_loc_id"
) -> DataFrame:
    """Rows of eligible stores, or of the others.

    One every-store mark makes all stores eligible.  It is asked for once, as a sub-query of
    its own, so the store match stays an equality.
    """
    everywhere = eligible.filter(F.col("rtl_loc_id") == codes.every_store).exists()
    marks = eligible.select(F.col("rtl_loc_id").alias("_store"), F.lit(True).alias("_marked"))
    matched = df.join(marks, F.col(store).cast("string") == F.col("_store"), "left")
    inside = everywhere | F.col("_marked").isNotNull()
    return matched.filter(inside if wanted else ~inside).drop("_store", "_marked")
