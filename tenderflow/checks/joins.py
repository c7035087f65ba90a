"""Joins, semi and anti joins, scalar look-ups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderflow.checks.register import DAY, check
from tenderflow.codes import Codes
from tenderflow.functions import code_like, full_name, scope_store
from tenderflow.operators import (
    business_dates,
    by_eligibility,
    eligible_stores,
    newest_pushes,
    ordered_listing,
    original_transactions,
    property_summary,
    scalar_lookup,
    session_matches,
)
from tenderflow.plans import over_short, tenders
from tenderflow.schemas import LINE_KEY, STORE_TXN_KEY, TOTAL, TXN_KEY

CODES = Codes()


@check("jn_txn_key", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, trans_statcode, typcode,
        n.amt as counted
    from trn_trans t
    join tsn_tndr_control_trans c
        using (organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq)
    join tsn_tndr_tndr_count n
        using (organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq)
""")
def txn_key(t):
    controls = t["tsn_tndr_control_trans"].select(*TXN_KEY, "typcode")
    counts = t["tsn_tndr_tndr_count"].select(*TXN_KEY, F.col("amt").alias("counted"))
    joined = t["trn_trans"].join(controls, TXN_KEY).join(counts, TXN_KEY)
    return joined.select(*TXN_KEY[1:], "trans_statcode", "typcode", "counted")


@check("jn_line_key", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq, tndr_id, amt,
        decimal_value
    from ttr_tndr_lineitm
    join trl_rtrans_lineitm using (
        organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq)
    join trl_rtrans_lineitm_p using (
        organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq)
    where void_flag = 0 and property_code = 'CPS_POSTED_TNDR_AMT'
""")
def line_key(t):
    live = tenders.live_lines(t, business_dates(t["ttr_tndr_lineitm"]))
    posted = t["trl_rtrans_lineitm_p"].filter(F.col("property_code") == CODES.posted_amount)
    joined = t["ttr_tndr_lineitm"].join(live, LINE_KEY).join(
        posted.select(*LINE_KEY, "decimal_value"), LINE_KEY
    )
    return joined.select(*LINE_KEY[1:], "tndr_id", "amt", "decimal_value")


@check("jn_partial_key", """
    select l.rtl_loc_id, l.business_date, count(*) as matches,
        cast(sum(l.amt) as decimal(27,6)) as amount
    from ttr_tndr_lineitm l
    join trn_trans n on n.organization_id = l.organization_id and n.rtl_loc_id = l.rtl_loc_id
        and n.business_date = l.business_date and n.trans_seq = l.trans_seq
    group by l.rtl_loc_id, l.business_date
""")
def partial_key(t):
    """Lines with the transactions of any workstation; both sides are counted first."""
    key = ["organization_id", "rtl_loc_id", "business_date", "trans_seq"]
    lines = t["ttr_tndr_lineitm"].groupBy(*key).agg(
        F.count("*").alias("lines"), F.sum("amt").alias("amt")
    )
    transactions = t["trn_trans"].groupBy(*key).agg(F.count("*").alias("n"))
    return lines.join(transactions, key).groupBy("rtl_loc_id", "business_date").agg(
        F.sum(F.col("lines") * F.col("n")).alias("matches"),
        F.sum(F.col("amt") * F.col("n")).cast(TOTAL).alias("amount"),
    )


@check("jn_dim_broadcast", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq, tndr_typcode,
        store_name, city
    from ttr_tndr_lineitm l join tnd_tndr d using (organization_id, tndr_id)
    join loc_rtl_loc s using (rtl_loc_id)
""")
def dim_broadcast(t):
    """No hint: Spark checks the size of a dimension and broadcasts it while it is small."""
    stores = t["loc_rtl_loc"].select("rtl_loc_id", "store_name", "city")
    joined = t["ttr_tndr_lineitm"].join(t["tnd_tndr"], ["organization_id", "tndr_id"])
    return joined.join(stores, "rtl_loc_id").select(
        *LINE_KEY[1:], "tndr_typcode", "store_name", "city"
    )


@check("jn_left_notes", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, typcode, note
    from tsn_tndr_control_trans left join trn_trans_notes
        using (organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq)
""")
def left_notes(t):
    controls = t["tsn_tndr_control_trans"].select(*TXN_KEY, "typcode")
    return controls.join(t["trn_trans_notes"], TXN_KEY, "left").drop("organization_id")


@check("jn_session_bags", """
    with bag as (
        select distinct w.wkstn_id, c.safe_bag_id, c.rtl_loc_id, c.business_date,
            c.outbound_session_id as session_id
        from tsn_session_wkstn w join tsn_tndr_control_trans c
            on c.organization_id = w.organization_id and c.rtl_loc_id = w.rtl_loc_id
            and c.outbound_session_id = w.session_id
        where c.safe_bag_id is not null
    )
    select rtl_loc_id, business_date, wkstn_id, session_id, safe_bag_id,
        count(*) as transactions
    from trn_trans left join bag using (rtl_loc_id, business_date, wkstn_id, session_id)
    group by all
""")
def session_bags(t):
    """Transactions of a session are counted before they meet its bags."""
    key = ["rtl_loc_id", "business_date", "wkstn_id", "session_id"]
    bags = tenders.session_bags(t, business_dates(t["trn_trans"]))
    transactions = t["trn_trans"].groupBy(*key).agg(F.count("*").alias("transactions"))
    return transactions.join(bags.drop("trans_seq").distinct(), key, "left")


@check("jn_store_day_deposits", """
    select t.rtl_loc_id, t.business_date, count(*) as transactions, any_value(d.deposits) as deposits
    from trn_trans t left join (
        select organization_id, rtl_loc_id, business_date,
            string_agg(string_value, ', ' order by string_value) as deposits
        from trn_trans_p where property_code like 'SMARTSAFE_DEPOSIT_ID%' group by all
    ) d using (organization_id, rtl_loc_id, business_date)
    group by t.organization_id, t.rtl_loc_id, t.business_date
""")
def store_day_deposits(t):
    store_day = ["organization_id", "rtl_loc_id", "business_date"]
    numbers = t["trn_trans_p"].filter(code_like(F.col("property_code"), CODES.deposit_id))
    listings = ordered_listing(numbers, store_day, "string_value", "deposits")
    transactions = t["trn_trans"].groupBy(*store_day).agg(F.count("*").alias("transactions"))
    return transactions.join(listings, store_day, "left").drop("organization_id")


@check("jn_reversal_link", """
    select l.rtl_loc_id, l.business_date, l.wkstn_id, l.trans_seq, l.rtrans_lineitm_seq,
        exists (
            select 1 from trl_rtrans_lineitm_p r
            where r.property_code = 'SPS_REVERSAL_ORIG_TRANS_ID'
                and r.organization_id = l.organization_id and r.rtl_loc_id = l.rtl_loc_id
                and r.business_date = l.business_date
                and try_cast(regexp_extract_all(r.string_value, '[^:]+')[4] as bigint) = l.wkstn_id
                and try_cast(regexp_extract_all(r.string_value, '[^:]+')[5] as bigint) = l.trans_seq
        ) as reversed
    from ttr_tndr_lineitm l
""")
def reversal_link(t):
    originals = original_transactions(t["trl_rtrans_lineitm_p"], CODES)
    linked = t["ttr_tndr_lineitm"].join(originals.withColumn("hit", F.lit(True)), TXN_KEY, "left")
    return linked.select(*LINE_KEY[1:], F.col("hit").isNotNull().alias("reversed"))


@check("jn_or_session", """
    select c.rtl_loc_id, c.business_date, c.wkstn_id, c.trans_seq, s.session_id
    from tsn_tndr_control_trans c join tsn_session s
        on s.organization_id = c.organization_id and s.rtl_loc_id = c.rtl_loc_id
        and (s.session_id = c.outbound_session_id or s.session_id = c.inbound_session_id)
""")
def or_session(t):
    controls = t["tsn_tndr_control_trans"].select(
        *TXN_KEY, "outbound_session_id", "inbound_session_id"
    )
    return session_matches(controls, t["tsn_session"]).select(*TXN_KEY[1:], "session_id")


def _matched_sql(condition: str) -> str:
    return f"""
        select c.rtl_loc_id, n.tndr_id, count(*) as matches,
            cast(sum(n.difference_amt) as decimal(27,6)) as difference
        from tsn_tndr_control_trans c join tsn_tndr_tndr_count n on {condition}
        join tnd_tndr d on d.organization_id = n.organization_id and d.tndr_id = n.tndr_id
        group by c.rtl_loc_id, n.tndr_id
    """


_SAME_TRANSACTION = """(
    c.organization_id = n.organization_id and c.rtl_loc_id = n.rtl_loc_id
    and c.business_date = n.business_date and c.wkstn_id = n.wkstn_id
    and c.trans_seq = n.trans_seq)"""


def _matched(t, strict: bool):
    controls = t["tsn_tndr_control_trans"].select(*TXN_KEY)
    own = over_short.own_counts(t, None, strict)
    return (
        over_short.matched_counts(controls, own, over_short.media_counts(t, controls, strict))
        .groupBy("rtl_loc_id", "tndr_id")
        .agg(
            F.sum("matches").alias("matches"),
            F.sum("difference").cast(TOTAL).alias("difference"),
        )
    )


@check("jn_or_precedence", _matched_sql(
    f"({_SAME_TRANSACTION} and n.difference_amt <> 0)"
    " or (n.media_count <> 0 and c.trans_seq = n.trans_seq)"
))
def or_precedence(t):
    return _matched(t, strict=False)


@check("jn_or_precedence_strict", _matched_sql(
    f"{_SAME_TRANSACTION} and (n.difference_amt <> 0 or n.media_count <> 0)"
))
def or_precedence_strict(t):
    return _matched(t, strict=True)


@check("jn_latest_version", """
    with pushed as (
        select organization_id, profile_group_id, profile_element_id, org_scope, config_version,
            coalesce(contains(changes, 'SmartSafeEnabled=true'), false) as enabled
        from cfg_profile_element_changes
        join dpl_deployment using (profile_group_id, profile_element_id, config_version)
        where change_type = 'SYSCFG' and change_subtype = 'SystemConfig.xml'
            and deployment_type = 'CONFIGURATOR'
            and deploy_status in ('COMPLETE', 'IN_PROCESS', 'SCHEDULED')
            and organization_id is not null),
    ranked as (
        select *, rank() over (
            partition by organization_id, profile_group_id, profile_element_id, org_scope
            order by config_version desc) as place
        from pushed)
    select organization_id, profile_group_id, profile_element_id, org_scope, config_version,
        bool_or(enabled) as "on"
    from ranked where place = 1 group by all
""")
def latest(t):
    """A tie at the highest version counts as on if any of its rows is."""
    return newest_pushes(t, CODES)


@check("dim_eligible_stores", "select rtl_loc_id from safe_store")
def eligible(t):
    return eligible_stores(t)


@check("sq_semi_sale_line", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq, amt
    from ttr_tndr_lineitm l where exists (
        select 1 from trl_sale_lineitm s
        where s.organization_id = l.organization_id and s.rtl_loc_id = l.rtl_loc_id
            and s.business_date = l.business_date and s.wkstn_id = l.wkstn_id
            and s.trans_seq = l.trans_seq and s.merch_level_1 <> 'NP')
""")
def semi_sale_line(t):
    lines = t["ttr_tndr_lineitm"]
    traits = tenders.with_traits(t, DAY, lines, business_dates(lines))
    return traits.filter(tenders.has_trait(tenders.ACCESSORY)).select(*LINE_KEY[1:], "amt")


@check("sq_anti_posted", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq, rtrans_lineitm_seq, amt
    from ttr_tndr_lineitm l where l.organization_id = 1 and amt <> 0 and not exists (
        select 1 from trl_rtrans_lineitm_p p
        where p.property_code = 'CPS_POSTED_TNDR_AMT'
            and p.organization_id = l.organization_id and p.rtl_loc_id = l.rtl_loc_id
            and p.wkstn_id = l.wkstn_id and p.trans_seq = l.trans_seq
            and p.rtrans_lineitm_seq = l.rtrans_lineitm_seq)
""")
def anti_posted(t):
    lines = t["ttr_tndr_lineitm"].filter(
        (F.col("organization_id") == DAY.organization_id) & (F.col("amt") != 0)
    )
    posted = tenders.posted_elsewhere(t, DAY, lines)
    unposted = tenders.mark_posted_here(lines, posted).filter(F.col("posted_here").isNull())
    return unposted.select(*LINE_KEY[1:], "amt")


@check("sq_semi_or_global", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq from trn_trans t
    where exists (select 1 from safe_store s
        where s.rtl_loc_id = cast(t.rtl_loc_id as varchar) or s.rtl_loc_id = '*:*')
""")
def semi_or_global(t):
    kept = by_eligibility(t["trn_trans"], eligible_stores(t), True, CODES)
    return kept.select(*TXN_KEY[1:])


@check("sq_anti_or_global", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq from trn_trans t
    where not exists (select 1 from safe_store s
        where s.rtl_loc_id = cast(t.rtl_loc_id as varchar) or s.rtl_loc_id = '*:*')
""")
def anti_or_global(t):
    kept = by_eligibility(t["trn_trans"], eligible_stores(t), False, CODES)
    return kept.select(*TXN_KEY[1:])


@check("sq_every_store_mark", """
    with marked as (
        select distinct case when c.config_version = 1 then '*:*'
            else replace(d.org_scope, 'STORE:', '') end as rtl_loc_id
        from cfg_profile_element_changes c
        join dpl_deployment d using (profile_group_id, profile_element_id, config_version)
        where contains(c.changes, 'SmartSafeEnabled=true')
    )
    select 'eligible' as side, rtl_loc_id, business_date, wkstn_id, trans_seq from trn_trans t
    where exists (select 1 from marked m
        where m.rtl_loc_id = cast(t.rtl_loc_id as varchar) or m.rtl_loc_id = '*:*')
    union all
    select 'other', rtl_loc_id, business_date, wkstn_id, trans_seq from trn_trans t
    where not exists (select 1 from marked m
        where m.rtl_loc_id = cast(t.rtl_loc_id as varchar) or m.rtl_loc_id = '*:*')
""")
def every_store_mark(t):
    """Pushes of the first version count for every store, so all are eligible and none other."""
    element = ["profile_group_id", "profile_element_id", "config_version"]
    enabled = t["cfg_profile_element_changes"].filter(F.col("changes").contains(CODES.safe_enabled))
    first = F.col("config_version") == 1
    marks = enabled.join(t["dpl_deployment"], element).select(
        F.when(first, CODES.every_store).otherwise(scope_store(F.col("org_scope"), CODES))
        .alias("rtl_loc_id")
    ).distinct()

    def side(name: str, wanted: bool):
        rows = by_eligibility(t["trn_trans"], marks, wanted, CODES)
        return rows.select(F.lit(name).alias("side"), *TXN_KEY[1:])

    return side("eligible", True).unionByName(side("other", False))


@check("sq_scalar_lookup", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq,
        (select employee_id from crm_party where party_id = c.create_user_id) as pid,
        (select first_name || ' ' || last_name from crm_party where party_id = c.create_user_id)
            as employee_name,
        (select note from trn_trans_notes n where n.rtl_loc_id = c.rtl_loc_id
            and n.business_date = c.business_date and n.wkstn_id = c.wkstn_id
            and n.trans_seq = c.trans_seq) as comments
    from tsn_tndr_tndr_count c
""")
def lookup(t):
    counts = t["tsn_tndr_tndr_count"].select(*STORE_TXN_KEY, "create_user_id")
    named = scalar_lookup(
        counts, t["crm_party"], {"create_user_id": "party_id"},
        {
            "pid": F.col("employee_id"),
            "employee_name": full_name(F.col("first_name"), F.col("last_name")),
        },
    )
    noted = scalar_lookup(
        named, t["trn_trans_notes"], {key: key for key in STORE_TXN_KEY},
        {"comments": F.col("note")},
    )
    return noted.drop("create_user_id")


@check("sq_scalar_distinct", """
    select rtl_loc_id, business_date, wkstn_id, trans_seq,
        (select distinct store_name from loc_rtl_loc s where s.rtl_loc_id = c.rtl_loc_id)
            as store_name,
        (select distinct address1 from loc_rtl_loc s where s.rtl_loc_id = c.rtl_loc_id)
            as store_address
    from tsn_tndr_tndr_count c
""")
def lookup_distinct(t):
    counts = t["tsn_tndr_tndr_count"].select(*STORE_TXN_KEY)
    return scalar_lookup(
        counts, t["loc_rtl_loc"], {"rtl_loc_id": "rtl_loc_id"},
        {"store_name": F.col("store_name"), "store_address": F.col("address1")}, distinct=True,
    )


_PROPERTY_OF_C = """p.organization_id = c.organization_id and p.rtl_loc_id = c.rtl_loc_id
    and p.business_date = c.business_date and p.wkstn_id = c.wkstn_id
    and p.trans_seq = c.trans_seq"""


@check("sq_scalar_sum", f"""
    select rtl_loc_id, business_date, wkstn_id, trans_seq,
        cast((select sum(coalesce(decimal_value, 0)) from trn_trans_p p
            where {_PROPERTY_OF_C} and p.property_code like 'SMARTSAFE_DEPOSIT_AMT%')
            as decimal(27,6)) as deposited_amount
    from trn_trans c
""")
def scalar_sum(t):
    sums = property_summary(
        t["trn_trans_p"], TXN_KEY, listed={}, summed={"deposited": CODES.deposit_amount}
    )
    deposited = F.col("deposited").cast(TOTAL).alias("deposited_amount")
    return t["trn_trans"].join(sums, TXN_KEY, "left").select(*TXN_KEY[1:], deposited)


@check("sq_scalar_listagg", f"""
    select rtl_loc_id, business_date, wkstn_id, trans_seq,
        (select string_agg(string_value, ', ' order by string_value) from trn_trans_p p
            where {_PROPERTY_OF_C} and p.property_code like 'SMARTSAFE_DEPOSIT_ID%') as deposits,
        (select string_agg(string_value, ', ' order by string_value) from trn_trans_p p
            where {_PROPERTY_OF_C} and p.property_code like 'CHA_SMARTSAFE_BATCH_NUM%') as batches
    from trn_trans c
""")
def scalar_listagg(t):
    lists = property_summary(
        t["trn_trans_p"], TXN_KEY,
        listed={"deposits": CODES.deposit_id, "batches": CODES.batch_number},
    )
    return t["trn_trans"].join(lists, TXN_KEY, "left").select(
        *TXN_KEY[1:], "deposits", "batches"
    )


@check("set_union_distinct", """
    select rtl_loc_id, business_date, create_user_id from ttr_tndr_lineitm
    union
    select rtl_loc_id, business_date, create_user_id from tsn_tndr_control_trans
""")
def union_distinct(t):
    columns = ["rtl_loc_id", "business_date", "create_user_id"]
    sales = t["ttr_tndr_lineitm"].select(*columns)
    return sales.unionByName(t["tsn_tndr_control_trans"].select(*columns)).distinct()


@check("set_union_all", """
    select rtl_loc_id, business_date, create_user_id, amt from ttr_tndr_lineitm
    union all
    select rtl_loc_id, business_date, create_user_id, amt from tsn_tndr_control_trans
""")
def union_all(t):
    columns = ["rtl_loc_id", "business_date", "create_user_id", "amt"]
    sales = t["ttr_tndr_lineitm"].select(*columns)
    return sales.unionByName(t["tsn_tndr_control_trans"].select(*columns))
