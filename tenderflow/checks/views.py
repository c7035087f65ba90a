"""The point-of-sale tables as SQL over the order tables, to put in front of a query."""

from __future__ import annotations

import re
from collections.abc import Collection

_KEY = "organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq"

VIEWS = {
    "o": """
        select *, 1000 + o_custkey % 25 as loc, 1 + o_custkey % 3 as wk,
            date '2024-01-01' + cast(o_orderkey % 7 as int) as bd,
            cast(date '2024-01-01' + cast(o_orderkey % 7 as int) as timestamp)
                + (o_orderkey % 1440) * interval '1' minute
                + case when o_orderkey % 17 = 0 then 1 else 0 end * interval '1' day as cd,
            case when o_custkey % 29 = 0 then 2 else 1 end as org, o_custkey as uid, cast(o_totalprice as decimal(17,6)) as amt,
            row_number() over (
                partition by o_custkey % 25, o_orderkey % 7, o_custkey % 3 order by o_orderkey
            ) as tseq
        from orders""",
    "loc_rtl_loc": """
        select 1 as organization_id, cast(1000 + n_nationkey as bigint) as rtl_loc_id,
            n_name as store_name, 'ADDR ' || n_name as address1, r_name as state,
            'CITY ' || n_name as city, r_name as district,
            cast(10000 + n_nationkey as varchar) as postal_code
        from nation join region on n_regionkey = r_regionkey""",
    "tnd_tndr": """
        select * from (values
            (1, 'USD_CURRENCY', 'CURRENCY'), (1, 'ACH_CHECK', 'CHECK'),
            (1, 'VISA', 'CREDIT_CARD'), (1, 'CHECK', 'CHECK')
        ) t(organization_id, tndr_id, tndr_typcode)""",
    "trn_trans": """
        select org as organization_id, loc as rtl_loc_id, bd as business_date, wk as wkstn_id,
            tseq as trans_seq,
            case when o_orderkey % 10 < 7 then 'RETAIL_SALE' else 'TENDER_CONTROL' end
                as trans_typcode,
            case o_orderstatus when 'F' then 'COMPLETE' when 'O' then 'NEW' else 'SUSPEND' end
                as trans_statcode,
            cd as create_date, uid as create_user_id, 10 * loc + wk as session_id
        from o""",
    "ttr_tndr_lineitm": """
        select org as organization_id, loc as rtl_loc_id, bd as business_date, wk as wkstn_id,
            tseq as trans_seq, n as rtrans_lineitm_seq,
            case (o_orderkey + n) % 4 when 0 then 'USD_CURRENCY' when 1 then 'ACH_CHECK'
                when 2 then 'VISA' else 'CHECK' end as tndr_id,
            cast(case when n = 1 then amt else amt / 4 end as decimal(17,6)) as amt,
            cd as create_date, uid as create_user_id
        from o, (values (1), (2)) t(n) where o_orderkey % 10 < 7""",
    "trl_rtrans_lineitm": f"""
        select {_KEY}, rtrans_lineitm_seq,
            case when trans_seq % 11 = 0 then 1 else 0 end as void_flag
        from ttr_tndr_lineitm""",
    "trl_rtrans_lineitm_p": f"""
        select {_KEY}, rtrans_lineitm_seq, 'CPS_POSTED_TNDR_AMT' as property_code,
            cast(null as varchar) as string_value,
            cast(amt - cast(trans_seq % 3 as decimal(17,6)) as decimal(17,6)) as decimal_value
        from ttr_tndr_lineitm where trans_seq % 2 = 0
        union all
        select {_KEY}, rtrans_lineitm_seq, 'CPS_POSTED_TNDR_AMT_' || cast(n as varchar),
            'P' || cast(n as varchar), cast(10 * n as decimal(17,6))
        from ttr_tndr_lineitm, (values (1), (2)) t(n) where trans_seq % 2 = 0
        union all
        select {_KEY}, rtrans_lineitm_seq, 'SPECTRUM_BILLER_ID',
            cast(8000000000 + trans_seq % 5 as varchar), null
        from ttr_tndr_lineitm where rtrans_lineitm_seq = 1
        union all
        select {_KEY}, rtrans_lineitm_seq, 'SPS_REVERSAL_ORIG_TRANS_ID',
            case when trans_seq % 26 = 0 then '1::short' else
                '1::' || cast(rtl_loc_id as varchar) || '::D::' || cast(wkstn_id as varchar)
                || '::' || cast(trans_seq as varchar) end, null
        from ttr_tndr_lineitm where trans_seq % 13 = 0 and rtrans_lineitm_seq = 1""",
    "trl_sale_lineitm": """
        select org as organization_id, loc as rtl_loc_id, bd as business_date, wk as wkstn_id,
            tseq as trans_seq, l_linenumber as rtrans_lineitm_seq,
            case l_partkey % 4 when 0 then 'MOBILEOTD0001' when 1 then 'MOBILEOTS0001'
                else 'ITEM' || cast(l_partkey % 4 as varchar) end as item_id,
            case l_partkey % 4 when 1 then 'MOBILEOTS0001' when 2 then 'SPECTRUM001'
                else 'SCAN' end as scanned_item_id,
            case when l_partkey % 3 = 0 then 'NP' else 'ACC' end as merch_level_1
        from lineitem join o on l_orderkey = o_orderkey""",
    "tsn_session": """
        select distinct organization_id, rtl_loc_id, session_id from trn_trans""",
    "tsn_session_wkstn": """
        select distinct organization_id, rtl_loc_id, session_id, wkstn_id from trn_trans""",
    "tsn_tndr_control_trans": """
        select org as organization_id, loc as rtl_loc_id, bd as business_date, wk as wkstn_id,
            tseq as trans_seq,
            case when o_orderkey % 3 = 0 and o_custkey % 9 = 0 then 'EndCount'
                when o_orderkey % 3 = 0 then 'ENDCOUNT'
                when o_orderkey % 3 = 1 then 'SAFE_BAG_ADJUST' else 'BANK_DEPOSIT' end as typcode,
            case when o_custkey % 13 < 3 then null when o_custkey % 13 < 6 then 'STOREBANK'
                when o_custkey % 13 < 9 then 'TILL1' else 'KIOSK' end
                as outbound_tndr_repository_id,
            case when o_custkey % 5 = 0 then 'SAFE' else 'CHANGEFUND' end
                as inbound_tndr_repository_id, 10 * loc + wk as outbound_session_id,
            10 * loc + wk + 1 as inbound_session_id, amt,
            case when o_custkey % 7 = 0 then 'MISCOUNT' end as reascode,
            case when o_orderkey % 4 = 0 then 'BAG' || cast(o_orderkey % 100 as varchar) end
                as safe_bag_id,
            cd as create_date, uid as create_user_id
        from o where o_orderkey % 10 >= 6""",
    "tsn_tndr_tndr_count": f"""
        select {_KEY}, case n when 0 then 'USD_CURRENCY' else 'CHECK' end as tndr_id,
            case n when 0 then 'CURRENCY' else 'CHECK' end as tndr_typcode, amt,
            amt as deposit_amt, cast(trans_seq % 5 - 2 as decimal(17,6)) as difference_amt,
            (trans_seq + n) % 2 as media_count, create_user_id
        from tsn_tndr_control_trans, (values (0), (1)) t(n) where n = 0 or trans_seq % 4 = 0""",
    "trn_trans_p": f"""
        select {_KEY}, 'SMARTSAFE_DEPOSIT_ID_' || cast(n as varchar) as property_code,
            'D' || cast(trans_seq % 9 + n as varchar) as string_value,
            cast(null as decimal(17,6)) as decimal_value
        from tsn_tndr_control_trans, (values (1), (2)) t(n)
        union all
        select {_KEY}, 'SMARTSAFE_DEPOSIT_AMT_1',
            case when trans_seq % 2 = 0 then 'Kiosk' else 'Till' end,
            cast(amt - 1 as decimal(17,6))
        from tsn_tndr_control_trans
        union all
        select {_KEY}, 'CHA_SMARTSAFE_BATCH_NUM_1', 'B' || cast(trans_seq % 4 as varchar), null
        from tsn_tndr_control_trans""",
    "trn_trans_notes": f"""
        select {_KEY}, 'note ' || cast(trans_seq % 6 as varchar) as note
        from tsn_tndr_control_trans where trans_seq % 2 = 0""",
    "crm_party": """
        select c_custkey as party_id, 'E' || cast(c_custkey as varchar) as employee_id,
            c_mktsegment as first_name, c_name as last_name
        from customer""",
    "hrs_employee": "select party_id, employee_id from crm_party",
    "cfg_profile_element_changes": """
        select 1 as organization_id, 'STORE' as profile_group_id,
            cast(n_regionkey as varchar) as profile_element_id, 'SYSCFG' as change_type,
            'SystemConfig.xml' as change_subtype, cast(n_nationkey as bigint) as config_version,
            case when n_regionkey in (0, 1) then 'x SmartSafeEnabled=true y'
                else 'SmartSafeEnabled=false' end as changes
        from nation
        union all
        select 1, 'SITE', 'S' || cast(s_suppkey as varchar), 'SYSCFG', 'SystemConfig.xml', n,
            case when (s_suppkey + n) % 3 = 0 then 'SmartSafeEnabled=true'
                else 'SmartSafeEnabled=false' end
        from supplier, (values (1), (2), (2)) t(n)
        union all
        select 1, 'SITE', 'S' || cast(s_suppkey as varchar), 'SYSCFG', 'SystemConfig.xml', 2,
            'a tie: SmartSafeEnabled=true'
        from supplier where s_suppkey % 4 = 0""",
    "dpl_deployment": """
        select cast(n_nationkey as bigint) as config_version,
            cast(n_regionkey as varchar) as profile_element_id, 'STORE' as profile_group_id,
            'CONFIGURATOR' as deployment_type,
            case when n_nationkey % 6 = 5 then 'FAILED' else 'COMPLETE' end as deploy_status,
            case when n_regionkey = 0 then 'WEST'
                else 'STORE:' || cast(1000 + n_nationkey as varchar) end as org_scope
        from nation
        union all
        select n, 'S' || cast(s_suppkey as varchar), 'SITE', 'CONFIGURATOR',
            case when n = 2 and s_suppkey % 5 = 0 then 'FAILED' else 'SCHEDULED' end,
            'STORE:' || cast(100000 + s_suppkey as varchar)
        from supplier, (values (1), (2)) t(n)""",
    "loc_rtl_loc_collection_element": """
        select 'WEST' as collection_name,
            'STORE:' || cast(1000 + n_nationkey as varchar) as org_scope_code
        from nation where n_nationkey % 5 = 0""",
    # the stores with a smart safe, asked for by several statements
    "safe_store": """
        select distinct replace(coalesce(org_scope_code, org_scope), 'STORE:', '') as rtl_loc_id
        from cfg_profile_element_changes
        join (
            select organization_id, profile_group_id, profile_element_id, change_type,
                change_subtype, org_scope, max(config_version) as config_version
            from cfg_profile_element_changes
            join dpl_deployment using (profile_group_id, profile_element_id, config_version)
            where change_type = 'SYSCFG' and change_subtype = 'SystemConfig.xml'
                and deployment_type = 'CONFIGURATOR'
                and deploy_status in ('COMPLETE', 'IN_PROCESS', 'SCHEDULED')
            group by all
        ) newest using (
            organization_id, profile_group_id, profile_element_id, change_type, change_subtype,
            config_version
        )
        left join loc_rtl_loc_collection_element on org_scope = collection_name
        where contains(changes, 'SmartSafeEnabled=true')""",
}


def _used(sql: str) -> set[str]:
    return {name for name in VIEWS if re.search(rf"(from|join|,)\s+{name}\b", sql)}


def with_views(sql: str, given: Collection[str] = ()) -> str:
    """Put the views a query needs in front of it, but for tables that are ``given``.

    The query may start with its own ``with``.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in sorted(_used(VIEWS[name]) - {name, *given}):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in sorted(_used(sql) - set(given)):
        add(name)
    views = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in ordered)
    body = sql.strip()
    if not views:
        return body
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"
