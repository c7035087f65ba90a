"""Scans, projections, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderflow import functions as fn
from tenderflow.checks.register import DAY, WEEK, check
from tenderflow.codes import Codes
from tenderflow.schemas import LINE_KEY, TXN_KEY

CODES = Codes()


@check("src_scan_tender_lines", """
    select organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq,
        tndr_id, amt
    from ttr_tndr_lineitm where business_date = date '2024-01-03'
""")
def scan_tender_lines(t):
    lines = t["ttr_tndr_lineitm"].filter(F.col("business_date") == F.lit(DAY.window.start))
    return lines.select(*LINE_KEY, "tndr_id", "amt")


@check("prj_rename", """
    select rtl_loc_id as store, business_date as trading_day, wkstn_id as till,
        trans_seq as ticket, tndr_id as tender, amt as amount
    from ttr_tndr_lineitm
""")
def rename(t):
    return t["ttr_tndr_lineitm"].select(
        F.col("rtl_loc_id").alias("store"), F.col("business_date").alias("trading_day"),
        F.col("wkstn_id").alias("till"), F.col("trans_seq").alias("ticket"),
        F.col("tndr_id").alias("tender"), F.col("amt").alias("amount"),
    )


@check("prj_literals", """
    select rtl_loc_id as locationid, 'OVER/SHORT' as department,
        cast(null as varchar) as billerid, cast(null as varchar) as bag_id
    from tsn_tndr_control_trans
""")
def literals(t):
    return t["tsn_tndr_control_trans"].select(
        F.col("rtl_loc_id").alias("locationid"), F.lit(CODES.over_short).alias("department"),
        F.lit(None).cast("string").alias("billerid"), F.lit(None).cast("string").alias("bag_id"),
    )


def _typed(t):
    return t["ttr_tndr_lineitm"].join(t["tnd_tndr"].select("tndr_id", "tndr_typcode"), "tndr_id")


@check("sc_payment_type", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq,
        case when tndr_typcode = 'CREDIT_CARD' or tndr_typcode is null then tndr_typcode
            when tndr_id = 'ACH_CHECK' then tndr_id else 'DEPOSIT' end as payment_type
    from ttr_tndr_lineitm join (select tndr_id, tndr_typcode from tnd_tndr) using (tndr_id)
""")
def payment_type(t):
    kind = fn.payment_type(F.col("tndr_typcode"), F.col("tndr_id"), CODES)
    return _typed(t).select(*LINE_KEY[1:], kind.alias("payment_type"))


@check("sc_deposit_ref", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq,
        case when tndr_typcode <> 'CREDIT_CARD' and tndr_id <> 'ACH_CHECK'
            then 'BAG' || cast(trans_seq as varchar) end as deposit_ref
    from ttr_tndr_lineitm join (select tndr_id, tndr_typcode from tnd_tndr) using (tndr_id)
""")
def deposit_ref(t):
    deposit = fn.is_deposit(F.col("tndr_typcode"), F.col("tndr_id"), CODES)
    bag = F.concat(F.lit("BAG"), F.col("trans_seq").cast("string"))
    return _typed(t).select(*LINE_KEY[1:], fn.deposit_only(deposit, bag).alias("deposit_ref"))


@check("sc_till_label", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq,
        case when outbound_tndr_repository_id is null then 'Store Bank Reconcile'
            when outbound_tndr_repository_id = 'STOREBANK' then 'Bank Deposit'
            else outbound_tndr_repository_id end as till_number
    from tsn_tndr_control_trans
""")
def till_label(t):
    label = fn.till_label(F.col("outbound_tndr_repository_id"), CODES)
    return t["tsn_tndr_control_trans"].select(*TXN_KEY[1:], label.alias("till_number"))


@check("sc_decimal_diff", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq,
        cast(amt - difference_amt as decimal(18,6)) as expected_amt
    from tsn_tndr_tndr_count
""")
def decimal_diff(t):
    expected = F.col("amt") - F.col("difference_amt")
    return t["tsn_tndr_tndr_count"].select(*TXN_KEY[1:], expected.alias("expected_amt"))


@check("sc_prefix8", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, string_value,
        substr(string_value, 1, 8) as billerid
    from trl_rtrans_lineitm_p where property_code = 'SPECTRUM_BILLER_ID'
""")
def prefix8(t):
    billers = t["trl_rtrans_lineitm_p"].filter(F.col("property_code") == CODES.biller)
    short = fn.first8(F.col("string_value")).alias("billerid")
    return billers.select(*TXN_KEY[1:], "string_value", short)


@check("sc_strip_prefix", """
    select config_version, org_scope, nullif(replace(org_scope, 'STORE:', ''), '') as store
    from dpl_deployment
""")
def strip_prefix(t):
    store = fn.scope_store(F.col("org_scope"), CODES).alias("store")
    return t["dpl_deployment"].select("config_version", "org_scope", store)


@check("sc_full_name", """
    select party_id, coalesce(first_name, '') || ' ' || coalesce(last_name, '') as employee_name
    from crm_party
""")
def full_name(t):
    name = fn.full_name(F.col("first_name"), F.col("last_name")).alias("employee_name")
    return t["crm_party"].select("party_id", name)


@check("sc_nth_token", """
    select rtl_loc_id, business_date, string_value,
        try_cast(regexp_extract_all(string_value, '[^:]+')[4] as bigint) as wkstn,
        try_cast(regexp_extract_all(string_value, '[^:]+')[5] as bigint) as seq,
        regexp_extract_all(string_value, '[^:]+')[9] as missing
    from trl_rtrans_lineitm_p where property_code = 'SPS_REVERSAL_ORIG_TRANS_ID'
""")
def nth_token(t):
    link = F.col("string_value")
    links = t["trl_rtrans_lineitm_p"].filter(F.col("property_code") == CODES.reversal_link)
    return links.select(
        "rtl_loc_id", "business_date", "string_value",
        fn.nth_run(link, ":", 4).try_cast("bigint").alias("wkstn"),
        fn.nth_run(link, ":", 5).try_cast("bigint").alias("seq"),
        fn.nth_run(link, ":", 9).alias("missing"),
    )


@check("sc_date_formats", """
    select rtl_loc_id, wkstn_id, trans_seq,
        strftime(create_date, '%Y%m%d') as compact, strftime(create_date, '%Y-%m-%d') as iso,
        strftime(business_date, '%m/%d/%Y') as us,
        upper(strftime(business_date, '%d-%b-%Y')) as named,
        upper(strftime(create_date, '%d-%b-%Y %H:%M')) as minute
    from trn_trans
""")
def date_formats(t):
    day, moment = F.col("business_date"), F.col("create_date")
    return t["trn_trans"].select(
        "rtl_loc_id", "wkstn_id", "trans_seq", fn.day_text(moment).alias("compact"),
        fn.iso_day_text(moment).alias("iso"), fn.us_day_text(day).alias("us"),
        fn.month_name_day_text(day).alias("named"), fn.minute_text(moment).alias("minute"),
    )


@check("flt_report_day", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq,
        strftime(create_date, '%Y-%m-%d') as created
    from trn_trans where cast(create_date as date) = date '2024-01-03'
""")
def report_day(t):
    day = t["trn_trans"].filter(fn.created_within(F.col("create_date"), DAY.window))
    return day.select(*TXN_KEY[1:], fn.iso_day_text(F.col("create_date")).alias("created"))


@check("flt_codes", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, outbound_tndr_repository_id
    from tsn_tndr_control_trans
    where outbound_tndr_repository_id <> 'STOREBANK' and typcode = 'ENDCOUNT'
""")
def codes(t):
    return t["tsn_tndr_control_trans"].filter(
        (F.col("outbound_tndr_repository_id") != CODES.store_bank)
        & (F.col("typcode") == CODES.end_count)
    ).select(*TXN_KEY[1:], "outbound_tndr_repository_id")


@check("flt_date_range", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq
    from ttr_tndr_lineitm
    where business_date >= date '2024-01-01' and business_date <= date '2024-01-07'
""")
def date_range(t):
    return t["ttr_tndr_lineitm"].filter(
        fn.dated_within(F.col("business_date"), WEEK.window)
    ).select(*LINE_KEY[1:])


@check("flt_upper_in", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, typcode
    from tsn_tndr_control_trans where upper(typcode) in ('ENDCOUNT', 'BANK_DEPOSIT')
""")
def upper_in(t):
    return t["tsn_tndr_control_trans"].filter(
        F.upper("typcode").isin(CODES.end_count, CODES.bank_deposit)
    ).select(*TXN_KEY[1:], "typcode")


@check("flt_not_in", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, item_id, scanned_item_id
    from trl_sale_lineitm where item_id not in ('MOBILEOTD0001', 'MOBILEOTS0001')
""")
def not_in(t):
    return t["trl_sale_lineitm"].filter(fn.is_core_sale(F.col("item_id"), CODES)).select(
        *TXN_KEY[1:], "item_id", "scanned_item_id"
    )


@check("flt_property_prefix", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, property_code, string_value
    from trn_trans_p where property_code like 'SMARTSAFE_DEPOSIT_ID%'
""")
def property_prefix(t):
    return t["trn_trans_p"].filter(
        fn.code_like(F.col("property_code"), CODES.deposit_id)
    ).select(*TXN_KEY[1:], "property_code", "string_value")


@check("flt_store_pattern", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq, 'all' as pattern
    from ttr_tndr_lineitm where rtl_loc_id is not null
    union all
    select rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq, '101_'
    from ttr_tndr_lineitm where cast(rtl_loc_id as varchar) like '101_'
""")
def store_pattern(t):
    lines, store = t["ttr_tndr_lineitm"].select(*LINE_KEY[1:]), F.col("rtl_loc_id")
    every = lines.filter(fn.store_matches(store, None)).withColumn("pattern", F.lit("all"))
    some = lines.filter(fn.store_matches(store, "101_")).withColumn("pattern", F.lit("101_"))
    return every.unionByName(some)


@check("flt_posted_amount_rule", """
    select l.rtl_loc_id, l.business_date, l.wkstn_id, l.trans_seq, l.rtrans_lineitm_seq,
        l.tndr_id, p.property_code, p.decimal_value
    from ttr_tndr_lineitm l join trl_rtrans_lineitm_p p using (
        organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq
    )
    where p.property_code like 'CPS_POSTED_TNDR_AMT%'
        and (p.property_code <> 'CPS_POSTED_TNDR_AMT' or l.tndr_id = 'ACH_CHECK')
""")
def posted_amount_rule(t):
    properties = t["trl_rtrans_lineitm_p"].filter(
        fn.code_like(F.col("property_code"), CODES.posted_amount)
    )
    return t["ttr_tndr_lineitm"].join(properties, LINE_KEY).filter(
        fn.posts_amount(F.col("property_code"), F.col("tndr_id"), CODES)
    ).select(*LINE_KEY[1:], "tndr_id", "property_code", "decimal_value")


@check("flt_null_checks", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, safe_bag_id
    from tsn_tndr_control_trans
    where safe_bag_id is not null and outbound_tndr_repository_id is null
""")
def null_checks(t):
    return t["tsn_tndr_control_trans"].filter(
        F.col("safe_bag_id").isNotNull() & F.col("outbound_tndr_repository_id").isNull()
    ).select(*TXN_KEY[1:], "safe_bag_id")
