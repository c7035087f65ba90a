"""Column types of the point-of-sale tables, and the keys that tie them together."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = "decimal(17,6)"
TOTAL = "decimal(27,6)"

#: one transaction of one workstation, and one line of it
TXN_KEY = ["organization_id", "rtl_loc_id", "business_date", "wkstn_id", "trans_seq"]
LINE_KEY = [*TXN_KEY, "rtrans_lineitm_seq"]

#: the workstation transaction without its organization
STORE_TXN_KEY = ["rtl_loc_id", "business_date", "wkstn_id", "trans_seq"]

_TXN = (
    "organization_id int, rtl_loc_id bigint, business_date date, "
    "wkstn_id bigint, trans_seq bigint"
)
_LINE = f"{_TXN}, rtrans_lineitm_seq int"
_PROPERTY = f"property_code string, string_value string, decimal_value {MONEY}"

DDL = {
    "ttr_tndr_lineitm": (
        f"{_LINE}, tndr_id string, amt {MONEY}, create_date timestamp, create_user_id bigint"
    ),
    "tnd_tndr": "organization_id int, tndr_id string, tndr_typcode string",
    "trl_rtrans_lineitm": f"{_LINE}, void_flag int",
    "trl_rtrans_lineitm_p": f"{_LINE}, {_PROPERTY}",
    "trl_sale_lineitm": (
        f"{_LINE}, item_id string, scanned_item_id string, merch_level_1 string"
    ),
    "trn_trans": (
        f"{_TXN}, trans_typcode string, trans_statcode string, session_id bigint, "
        "create_date timestamp, create_user_id bigint"
    ),
    "trn_trans_p": f"{_TXN}, {_PROPERTY}",
    "trn_trans_notes": f"{_TXN}, note string",
    "tsn_session": "organization_id int, rtl_loc_id bigint, session_id bigint",
    "tsn_session_wkstn": (
        "organization_id int, rtl_loc_id bigint, session_id bigint, wkstn_id bigint"
    ),
    "tsn_tndr_control_trans": (
        f"{_TXN}, typcode string, outbound_tndr_repository_id string, "
        "inbound_tndr_repository_id string, outbound_session_id bigint, "
        f"inbound_session_id bigint, amt {MONEY}, reascode string, safe_bag_id string, "
        "create_date timestamp, create_user_id bigint"
    ),
    "tsn_tndr_tndr_count": (
        f"{_TXN}, tndr_id string, tndr_typcode string, amt {MONEY}, deposit_amt {MONEY}, "
        f"difference_amt {MONEY}, media_count bigint, create_user_id bigint"
    ),
    "loc_rtl_loc": (
        "organization_id int, rtl_loc_id bigint, store_name string, address1 string, "
        "state string, city string, district string, postal_code string"
    ),
    "crm_party": "party_id bigint, employee_id string, first_name string, last_name string",
    "hrs_employee": "party_id bigint, employee_id string",
    "cfg_profile_element_changes": (
        "organization_id int, profile_group_id string, profile_element_id string, "
        "change_type string, change_subtype string, config_version bigint, changes string"
    ),
    "dpl_deployment": (
        "config_version bigint, profile_element_id string, profile_group_id string, "
        "deployment_type string, deploy_status string, org_scope string"
    ),
    "loc_rtl_loc_collection_element": "collection_name string, org_scope_code string",
}

TABLES = tuple(DDL)

#: tables that hold one partition per business date when stored as files
DATED_TABLES = tuple(name for name, ddl in DDL.items() if "business_date" in ddl)


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
