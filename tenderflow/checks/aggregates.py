"""Aggregates and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderflow.checks.register import check
from tenderflow.codes import Codes
from tenderflow.functions import code_like, day_text, first8, payment_type, till_label
from tenderflow.operators import ordered_listing, original_transactions
from tenderflow.plans.ach import ORDER as ACH_ORDER
from tenderflow.schemas import TOTAL, TXN_KEY

CODES = Codes()


@check("agg_sum", """
    select rtl_loc_id, tndr_id, cast(sum(amt) as decimal(27,6)) as amount
    from ttr_tndr_lineitm group by rtl_loc_id, tndr_id
""")
def agg_sum(t):
    totals = t["ttr_tndr_lineitm"].groupBy("rtl_loc_id", "tndr_id")
    return totals.agg(F.sum("amt").cast(TOTAL).alias("amount"))


@check("agg_count_col", """
    select rtl_loc_id, count(reascode) as reasons, count(safe_bag_id) as bags
    from tsn_tndr_control_trans group by rtl_loc_id
""")
def agg_count_col(t):
    return t["tsn_tndr_control_trans"].groupBy("rtl_loc_id").agg(
        F.count("reascode").alias("reasons"), F.count("safe_bag_id").alias("bags")
    )


@check("agg_max_version", """
    select profile_group_id, profile_element_id, org_scope,
        max(config_version) as config_version
    from cfg_profile_element_changes
    join dpl_deployment using (profile_group_id, profile_element_id, config_version)
    group by profile_group_id, profile_element_id, org_scope
""")
def agg_max_version(t):
    element = ["profile_group_id", "profile_element_id"]
    pushed = t["cfg_profile_element_changes"].join(
        t["dpl_deployment"], [*element, "config_version"]
    )
    return pushed.groupBy(*element, "org_scope").agg(
        F.max("config_version").alias("config_version")
    )


@check("agg_conditional_sum", """
    select p.rtl_loc_id, cast(sum(case when r.trans_seq is not null then 0
        else p.decimal_value end) as decimal(27,6)) as amount
    from trl_rtrans_lineitm_p p left join (
        select distinct organization_id, rtl_loc_id, business_date,
            try_cast(regexp_extract_all(string_value, '[^:]+')[4] as bigint) as wkstn_id,
            try_cast(regexp_extract_all(string_value, '[^:]+')[5] as bigint) as trans_seq
        from trl_rtrans_lineitm_p where property_code = 'SPS_REVERSAL_ORIG_TRANS_ID'
    ) r using (organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq)
    where p.property_code like 'CPS_POSTED_TNDR_AMT%'
    group by p.rtl_loc_id
""")
def agg_conditional_sum(t):
    properties = t["trl_rtrans_lineitm_p"]
    reversed_ones = original_transactions(properties, CODES).withColumn("hit", F.lit(True))
    posted = properties.filter(code_like(F.col("property_code"), CODES.posted_amount))
    amount = F.when(F.col("hit"), 0).otherwise(F.col("decimal_value"))
    return posted.join(reversed_ones, TXN_KEY, "left").groupBy("rtl_loc_id").agg(
        F.sum(amount).cast(TOTAL).alias("amount")
    )


@check("agg_listagg", """
    select rtl_loc_id, business_date, string_agg(string_value, ', ' order by string_value)
        as deposits
    from trn_trans_p where property_code like 'SMARTSAFE_DEPOSIT_ID%'
    group by rtl_loc_id, business_date
""")
def agg_listagg(t):
    numbers = t["trn_trans_p"].filter(code_like(F.col("property_code"), CODES.deposit_id))
    return ordered_listing(numbers, ["rtl_loc_id", "business_date"], "string_value", "deposits")


@check("agg_group_by_expr", """
    select strftime(create_date, '%Y%m%d') as trans_date,
        case when tndr_typcode = 'CREDIT_CARD' then tndr_typcode
            when tndr_id = 'ACH_CHECK' then tndr_id else 'DEPOSIT' end as payment_type,
        cast(sum(amt) as decimal(27,6)) as amount
    from ttr_tndr_lineitm join tnd_tndr using (organization_id, tndr_id) group by all
""")
def agg_group_by_expr(t):
    typed = t["ttr_tndr_lineitm"].join(t["tnd_tndr"], ["organization_id", "tndr_id"])
    kind = payment_type(F.col("tndr_typcode"), F.col("tndr_id"), CODES)
    return typed.groupBy(
        day_text(F.col("create_date")).alias("trans_date"), kind.alias("payment_type")
    ).agg(F.sum("amt").cast(TOTAL).alias("amount"))


@check("agg_hidden_key", """
    select distinct rtl_loc_id, amount from (
        select rtl_loc_id, business_date, string_value, cast(sum(decimal_value) as decimal(27,6))
            as amount
        from trl_rtrans_lineitm_p where property_code like 'CPS_POSTED_TNDR_AMT%'
        group by rtl_loc_id, business_date, string_value)
""")
def agg_hidden_key(t):
    """Grouped by keys that are not shown; equal rows that remain are merged."""
    posted = t["trl_rtrans_lineitm_p"].filter(
        code_like(F.col("property_code"), CODES.posted_amount)
    )
    totals = posted.groupBy("rtl_loc_id", "business_date", "string_value").agg(
        F.sum("decimal_value").cast(TOTAL).alias("amount")
    )
    return totals.select("rtl_loc_id", "amount").distinct()


@check("agg_distinct_rows", """
    select distinct rtl_loc_id, business_date, wkstn_id, rtrans_lineitm_seq,
        substr(string_value, 1, 8) as billerid
    from trl_rtrans_lineitm_p where property_code = 'SPECTRUM_BILLER_ID'
""")
def agg_distinct_rows(t):
    billers = t["trl_rtrans_lineitm_p"].filter(F.col("property_code") == CODES.biller)
    return billers.select(
        "rtl_loc_id", "business_date", "wkstn_id", "rtrans_lineitm_seq",
        first8(F.col("string_value")).alias("billerid"),
    ).distinct()


@check("agg_having_nonzero", """
    select rtl_loc_id, business_date, cast(sum(difference_amt) as decimal(27,6)) as difference
    from tsn_tndr_tndr_count group by rtl_loc_id, business_date having sum(difference_amt) <> 0
""")
def agg_having_nonzero(t):
    totals = t["tsn_tndr_tndr_count"].groupBy("rtl_loc_id", "business_date")
    return totals.agg(F.sum("difference_amt").cast(TOTAL).alias("difference")).filter(
        F.col("difference") != 0
    )


@check("srt_top_level", """
    select rtl_loc_id as store, strftime(business_date, '%m/%d/%Y') as business_date,
        count(*) as lines
    from ttr_tndr_lineitm group by all order by store, 2
""")
def srt_top_level(t):
    day = F.date_format("business_date", "MM/dd/yyyy").alias("business_date")
    lines = t["ttr_tndr_lineitm"].groupBy(F.col("rtl_loc_id").alias("store"), day)
    return lines.agg(F.count("*").alias("lines")).orderBy(*ACH_ORDER)


@check("srt_report_order", """
    select rtl_loc_id as locationid,
        case when outbound_tndr_repository_id is null then 'Store Bank Reconcile'
            when outbound_tndr_repository_id = 'STOREBANK' then 'Bank Deposit'
            else outbound_tndr_repository_id end as till_number,
        cast(sum(amt) as decimal(27,6)) as amount
    from tsn_tndr_control_trans group by all order by locationid, till_number
""")
def srt_report_order(t):
    label = till_label(F.col("outbound_tndr_repository_id"), CODES).alias("till_number")
    totals = t["tsn_tndr_control_trans"].groupBy(F.col("rtl_loc_id").alias("locationid"), label)
    return totals.agg(F.sum("amt").cast(TOTAL).alias("amount")).orderBy(
        "locationid", "till_number"
    )
