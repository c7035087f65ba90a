"""The statements and their parts.  The SQL joins row by row; nothing in it is added up early."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from tenderflow.checks.register import DAY, WEEK, check
from tenderflow.params import ReportParams, Window, till_window
from tenderflow.plans import treasury as plan
from tenderflow.plans.ach import ach_checks
from tenderflow.plans.backfill import backfill
from tenderflow.plans.change_fund import change_fund
from tenderflow.plans.kiosk import kiosk_reconcile
from tenderflow.plans.till_variance import till_variance
from tenderflow.plans.treasury import smartsafe_treasury, treasury

TXN = "organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq"
TILL = ReportParams(till_window(date(2024, 1, 4)))
RUNS = ReportParams(Window(date(2024, 1, 4), date(2024, 1, 13)))


def _created(window: Window) -> str:
    return (
        f"cast(create_date as date) between date '{window.start}' and date '{window.end}' "
        "and organization_id = 1 and rtl_loc_id is not null"
    )


_SAFE = """exists (select 1 from safe_store s
    where s.rtl_loc_id = cast({store} as varchar) or s.rtl_loc_id = '*:*')"""


# ---- ACH checks ---------------------------------------------------------------------------

def _ach_sql(first: str, last: str) -> str:
    return f"""
        select rtl_loc_id as store, store_name, address1, state, city, district, postal_code,
            strftime(business_date, '%m/%d/%Y') as business_date,
            count(tndr_id) as achtransactions, cast(sum(amt) as decimal(27,6)) as "sum"
        from ttr_tndr_lineitm l join loc_rtl_loc s using (rtl_loc_id)
        where tndr_id = 'ACH_CHECK' and business_date between {first} and {last}
        group by all having sum(amt) <> 0
        order by store, 8
    """


@check("rpt_ach_checks", _ach_sql("date '2024-01-01'", "date '2024-01-07'"))
def rpt_ach_checks(t):
    return ach_checks(t, WEEK)


@check("rpt_backfill_ach_weekly", f"""
    with run(report_date) as (
        select cast(day as date)
        from generate_series(timestamp '2024-01-04', timestamp '2024-01-13', interval 7 day) g(day)
    )
    select report_date, a.* from run, lateral (
        {_ach_sql("report_date - 7", "report_date - 1")}
    ) a
""")
def rpt_backfill_ach_weekly(t):
    return backfill("ach_checks", t, RUNS)


# ---- change fund and kiosk ----------------------------------------------------------------

def _change_fund_sql(window: Window) -> str:
    return f"""
        select strftime(t.create_date, '%Y-%m-%d') as trans_date, t.rtl_loc_id as "store#",
            n.amt as change_fund_order_amount_received, n.deposit_amt as amount_deposited,
            (select string_agg(string_value, ', ' order by string_value) from trn_trans_p p
                where p.organization_id = t.organization_id and p.rtl_loc_id = t.rtl_loc_id
                and p.business_date = t.business_date and p.wkstn_id = t.wkstn_id
                and p.trans_seq = t.trans_seq and property_code like 'SMARTSAFE_DEPOSIT_ID%')
                as "smartsafe_transaction#",
            n.difference_amt as variance, c.reascode as reason_code, note as comments
        from (select * from trn_trans where {_created(window)}
            and trans_typcode = 'TENDER_CONTROL' and trans_statcode = 'COMPLETE') t
        join tsn_tndr_control_trans c using ({TXN})
        join tsn_tndr_tndr_count n using ({TXN})
        left join trn_trans_notes using ({TXN})
        where c.typcode = 'SAFE_BAG_ADJUST' and c.inbound_tndr_repository_id = 'CHANGEFUND'
            and {_SAFE.format(store="t.rtl_loc_id")}
    """


@check("rpt_change_fund", _change_fund_sql(DAY.window))
def rpt_change_fund(t):
    return change_fund(t, DAY)


@check("rpt_backfill_change_fund", f"""
    select *, cast(trans_date as date) as report_date from ({_change_fund_sql(WEEK.window)})
""")
def rpt_backfill_change_fund(t):
    return backfill("change_fund", t, WEEK)


def _kiosk_sql(window: Window) -> str:
    return f"""
        select trans_date, "store#", amount_expected, deposited_amount,
            cast(amount_expected - deposited_amount as decimal(27,6)) as variance,
            "smartsafe_transaction#", variance_reason_code, batch_number, comments
        from (
            select strftime(t.create_date, '%Y-%m-%d') as trans_date, t.rtl_loc_id as "store#",
                c.amt as amount_expected, d.deposited_amount, d."smartsafe_transaction#",
                c.reascode as variance_reason_code, d.batch_number, note as comments
            from (select * from trn_trans where {_created(window)}
                and trans_typcode = 'TENDER_CONTROL' and trans_statcode in ('NEW', 'COMPLETE')) t
            join tsn_tndr_control_trans c using ({TXN})
            left join trn_trans_notes using ({TXN})
            left join (
                select {TXN},
                    cast(sum(coalesce(decimal_value, 0)) filter (
                        property_code like 'SMARTSAFE_DEPOSIT_AMT%') as decimal(27,6))
                        as deposited_amount,
                    string_agg(string_value, ', ' order by string_value) filter (
                        property_code like 'SMARTSAFE_DEPOSIT_ID%') as "smartsafe_transaction#",
                    string_agg(string_value, ', ' order by string_value) filter (
                        property_code like 'CHA_SMARTSAFE_BATCH_NUM%') as batch_number
                from trn_trans_p group by all
            ) d using ({TXN})
            where c.typcode = 'ENDCOUNT' and c.outbound_tndr_repository_id = 'KIOSK'
                and {_SAFE.format(store="t.rtl_loc_id")}
        )
    """


@check("rpt_kiosk", _kiosk_sql(DAY.window))
def rpt_kiosk(t):
    return kiosk_reconcile(t, DAY)


@check("rpt_backfill_kiosk", f"""
    select *, cast(trans_date as date) as report_date from ({_kiosk_sql(WEEK.window)})
""")
def rpt_backfill_kiosk(t):
    return backfill("kiosk_reconcile", t, WEEK)


# ---- till variance ------------------------------------------------------------------------

def _till_sql(window: Window, extra: str = "") -> str:
    return f"""
        select distinct c.rtl_loc_id as store,
            (select distinct store_name from loc_rtl_loc s where s.rtl_loc_id = n.rtl_loc_id)
                as store_name,
            (select distinct address1 from loc_rtl_loc s where s.rtl_loc_id = n.rtl_loc_id)
                as store_address,
            upper(strftime(c.business_date, '%d-%b-%Y')) as business_date,
            case when c.outbound_tndr_repository_id is null then 'Store Bank Reconcile'
                when c.outbound_tndr_repository_id = 'STOREBANK' then 'Bank Deposit'
                else c.outbound_tndr_repository_id end as till_number,
            p.employee_id as pid, p.first_name || ' ' || p.last_name as employee_name,
            cast(n.amt - n.difference_amt as decimal(18,6)) as expected_amt,
            n.amt as actual_amt, n.difference_amt as variance, c.reascode,
            note as comments,
            upper(strftime(c.create_date, '%d-%b-%Y %H:%M')) as create_date{extra}
        from tsn_tndr_control_trans c
        join tsn_tndr_tndr_count n using ({TXN})
        join tnd_tndr d on d.organization_id = n.organization_id and d.tndr_id = n.tndr_id
        left join crm_party p on p.party_id = n.create_user_id
        left join trn_trans_notes m using (rtl_loc_id, business_date, wkstn_id, trans_seq)
        join tsn_session z on z.organization_id = c.organization_id
            and z.rtl_loc_id = c.rtl_loc_id
            and z.session_id in (c.outbound_session_id, c.inbound_session_id)
        where upper(c.typcode) in ('ENDCOUNT', 'BANK_DEPOSIT')
            and c.business_date between date '{window.start}' and date '{window.end}'
            and n.tndr_typcode = 'CURRENCY' and n.tndr_id = 'USD_CURRENCY'
            and n.difference_amt <> 0
    """


@check("rpt_till_variance", f"{_till_sql(TILL.window)} order by store, till_number")
def rpt_till_variance(t):
    return till_variance(t, TILL)


@check("rpt_backfill_till_variance", _till_sql(
    WEEK.window, ",\n            c.business_date as report_date"
))
def rpt_backfill_till_variance(t):
    return backfill("till_variance", t, WEEK)


# ---- treasury -----------------------------------------------------------------------------

def _parts(window: Window, safe: bool, strict: bool = False) -> str:
    """Branch rows of a treasury as ``branch(part, ...)``, before stores are told apart."""
    created = _created(window)
    if safe:
        reference = f"""
            deposit as (
                select organization_id, rtl_loc_id, business_date,
                    string_agg(string_value, ', ' order by string_value) as ref
                from trn_trans_p where property_code like 'SMARTSAFE_DEPOSIT_ID%' group by all
            ),"""
        by_department = by_session = (
            "left join deposit using (organization_id, rtl_loc_id, business_date)"
        )
    else:
        reference = """
            out_bag as (
                select distinct w.wkstn_id, c.safe_bag_id as ref, c.rtl_loc_id, c.business_date,
                    c.outbound_session_id as session_id, c.trans_seq as bag_seq
                from tsn_tndr_control_trans c join tsn_session_wkstn w
                    on w.organization_id = c.organization_id and w.rtl_loc_id = c.rtl_loc_id
                    and w.session_id = c.outbound_session_id
                where c.safe_bag_id is not null
            ),
            day_bag as (select distinct * exclude (bag_seq) from out_bag),
            any_bag as (
                select true as whole_session, *, null as bag_seq from day_bag
                union all by name select false as whole_session, * from out_bag
            ),"""
        same = """b.wkstn_id = l.wkstn_id and b.business_date = l.business_date
            and b.rtl_loc_id = l.rtl_loc_id and b.session_id = n.session_id"""
        by_department = f"""left join any_bag b on {same}
            and b.whole_session = (i.department = 'CORE')
            and (b.whole_session or b.bag_seq = n.trans_seq)"""
        by_session = f"left join day_bag b on {same}"
    same_transaction = (
        "c.organization_id = n.organization_id and c.rtl_loc_id = n.rtl_loc_id "
        "and c.business_date = n.business_date and c.wkstn_id = n.wkstn_id "
        "and c.trans_seq = n.trans_seq"
    )
    matched = (
        f"({same_transaction}) and (n.difference_amt <> 0 or n.media_count <> 0)" if strict
        else f"(({same_transaction}) and n.difference_amt <> 0)"
        " or (n.media_count <> 0 and c.trans_seq = n.trans_seq)"
    )
    differences = f"""
        select n.tndr_id, cast(n.difference_amt as decimal(18,6)) as difference, c.rtl_loc_id,
            c.create_date, c.create_user_id, {", ".join("c." + k for k in TXN.split(", "))}
        from end_count c join tsn_tndr_tndr_count n on {matched}
        join tnd_tndr d on d.organization_id = n.organization_id and d.tndr_id = n.tndr_id"""
    if safe:
        differences = f"""
            select q.*, (select string_agg(string_value, ', ' order by string_value)
                from trn_trans_p p where {same_transaction.replace("c.", "p.").replace("n.", "q.")}
                and property_code like 'SMARTSAFE_DEPOSIT_ID%') as ref
            from (
                {differences}
                union
                select 'USD_CURRENCY', cast(n.decimal_value - c.amt as decimal(18,6)),
                    c.rtl_loc_id, c.create_date, c.create_user_id,
                    {", ".join("c." + k for k in TXN.split(", "))}
                from end_count c join trn_trans_p n on {same_transaction}
                where n.property_code like 'SMARTSAFE_DEPOSIT_AMT%' and exists (
                    select 1 from trn_trans_p p
                    where {same_transaction.replace("n.", "p.")} and string_value = 'Kiosk')
            ) q"""
    return f"""
    with live as (
        select {TXN}, rtrans_lineitm_seq from trl_rtrans_lineitm where void_flag = 0
    ),
    line as (
        select {TXN}, rtrans_lineitm_seq, l.tndr_id, amt, create_user_id,
            strftime(create_date, '%Y%m%d') as trans_date,
            case when tndr_typcode <> 'CREDIT_CARD' and l.tndr_id <> 'ACH_CHECK' then 'DEPOSIT'
                when tndr_typcode <> 'CREDIT_CARD' then l.tndr_id
                else tndr_typcode end as payment_type,
            coalesce(tndr_typcode <> 'CREDIT_CARD' and l.tndr_id <> 'ACH_CHECK', false) as shows
        from (select * from ttr_tndr_lineitm where {created}) l
        join (select tndr_id, tndr_typcode from tnd_tndr) d using (tndr_id)
        join live using ({TXN}, rtrans_lineitm_seq)
    ),
    named_reversal as (
        select organization_id, rtl_loc_id, business_date,
            try_cast(regexp_extract_all(string_value, '[^:]+')[4] as bigint) as wkstn_id,
            try_cast(regexp_extract_all(string_value, '[^:]+')[5] as bigint) as trans_seq, true as void
        from trl_rtrans_lineitm_p where property_code = 'SPS_REVERSAL_ORIG_TRANS_ID'
    ),
    item as (
        select distinct department, string_value as id, rtl_loc_id, business_date, wkstn_id,
            trans_seq, p.rtrans_lineitm_seq as item_line
        from trl_rtrans_lineitm_p p join live using ({TXN}, rtrans_lineitm_seq)
        join trl_sale_lineitm s using ({TXN}),
        (values ('CORE'), ('MOBILE DEVICE PAYMENT'), ('MOBILE SERVICE PAYMENT')) v(department)
        where property_code = 'SPECTRUM_BILLER_ID' and case department
            when 'CORE' then item_id not in ('MOBILEOTD0001', 'MOBILEOTS0001')
            when 'MOBILE SERVICE PAYMENT' then scanned_item_id = 'MOBILEOTS0001'
            else item_id = 'MOBILEOTD0001'
                and scanned_item_id not in ('SPECTRUM001', 'MOBILEOTS0001') end
    ),
    {reference}
    billed as (
        select l.rtl_loc_id, trans_date, department, substr(id, 1, 8) as billerid, payment_type,
            case when shows then ref end as ref, l.create_user_id,
            sum(case when void then 0 else decimal_value end) as amount
        from line l join trl_rtrans_lineitm_p p using ({TXN}, rtrans_lineitm_seq)
        left join named_reversal using ({TXN})
        join trn_trans n using ({TXN})
        join item i using (rtl_loc_id, business_date, wkstn_id, trans_seq)
        {by_department}
        where property_code like 'CPS_POSTED_TNDR_AMT%'
            and (property_code <> 'CPS_POSTED_TNDR_AMT' or l.tndr_id = 'ACH_CHECK')
        group by l.rtl_loc_id, trans_date, department, billerid, payment_type,
            case when shows then ref end, l.create_user_id, string_value
    ),
    sold_line as (
        select * from line l where exists (
            select 1 from trl_sale_lineitm s where s.organization_id = l.organization_id
                and s.rtl_loc_id = l.rtl_loc_id and s.business_date = l.business_date
                and s.wkstn_id = l.wkstn_id and s.trans_seq = l.trans_seq
                and s.merch_level_1 <> 'NP')
    ),
    posted as (
        select organization_id, rtl_loc_id, trans_seq, rtrans_lineitm_seq, wkstn_id as on_wkstn,
            decimal_value
        from trl_rtrans_lineitm_p where property_code = 'CPS_POSTED_TNDR_AMT'
    ),
    remainder as (
        select l.*, amt - decimal_value as left_over from sold_line l
        join posted using (organization_id, rtl_loc_id, trans_seq, rtrans_lineitm_seq)
        where amt - decimal_value > 0
        union all by name
        select l.*, amt as left_over from sold_line l where amt <> 0 and not exists (
            select 1 from posted p where p.organization_id = l.organization_id
                and p.rtl_loc_id = l.rtl_loc_id and p.trans_seq = l.trans_seq
                and p.rtrans_lineitm_seq = l.rtrans_lineitm_seq and p.on_wkstn = l.wkstn_id)
    ),
    accessory as (
        select l.rtl_loc_id, trans_date, payment_type, case when shows then ref end as ref,
            l.create_user_id, sum(left_over) as amount
        from remainder l
        join trn_trans n using (organization_id, rtl_loc_id, business_date, trans_seq)
        {by_session}
        group by l.rtl_loc_id, trans_date, payment_type, case when shows then ref end,
            l.create_user_id
        having sum(left_over) <> 0
    ),
    end_count as (
        select c.* from tsn_tndr_control_trans c join tsn_session z
            on z.rtl_loc_id = c.rtl_loc_id and z.organization_id = c.organization_id
            and z.session_id = c.outbound_session_id
        where upper(typcode) = 'ENDCOUNT' and {created.replace("and organization_id",
            "and c.organization_id").replace("and rtl_loc_id", "and c.rtl_loc_id")}
    ),
    difference as ({differences}),
    over_short as (
        select rtl_loc_id, strftime(create_date, '%Y%m%d') as trans_date, tndr_id,
            {"ref" if safe else "null"} as ref, create_user_id, sum(difference) as amount
        from difference
        group by tndr_id, create_date, rtl_loc_id, create_user_id{", ref" if safe else ""}
        having sum(difference) <> 0
    ),
    branch as (
        select department, rtl_loc_id as locationid, cast(amount as decimal(27,6)) as amount,
            trans_date, billerid, payment_type, ref, create_user_id
        from billed
        union all
        select 'ACCESSORY', rtl_loc_id, cast(amount as decimal(27,6)), trans_date,
            cast(null as varchar), payment_type, ref, create_user_id from accessory
        union all
        select 'OVER/SHORT', rtl_loc_id, cast(amount as decimal(27,6)), trans_date,
            cast(null as varchar), tndr_id, cast(ref as varchar), create_user_id
        from over_short
    )"""


def _branch_sql(department: str, safe: bool, strict: bool = False) -> str:
    return f"""{_parts(DAY.window, safe, strict)}
    select locationid, amount, trans_date, department, billerid, payment_type,
        ref as {"deposits" if safe else "bag_id"}, create_user_id
    from branch where department = '{department}'"""


def _report_sql(window: Window, safe: bool, extra: str = "") -> str:
    reference = "deposits" if safe else "bag_id"
    return f"""{_parts(window, safe)}
    select locationid, amount, trans_date, department, billerid, payment_type,
        ref as {reference}, employee_id as pid{extra}
    from (select distinct * from branch) left join hrs_employee on party_id = create_user_id
    where {"" if safe else "not "}{_SAFE.format(store="locationid")}
    order by locationid, department"""


# one name per part of a report: (part it is computed in, department it shows)
_PARTS = {
    "core": ("payments", "CORE"),
    "device": ("payments", "MOBILE DEVICE PAYMENT"),
    "service": ("payments", "MOBILE SERVICE PAYMENT"),
    "accessory": ("payments", "ACCESSORY"),
    "overshort": ("over_short", "OVER/SHORT"),
}


def _branch(safe: bool, part: str, department: str, params: ReportParams):
    def build(t):
        branches = (plan.smartsafe_branches if safe else plan.treasury_branches)(t, params)
        rows = branches.shown(branches.parts[part].filter(F.col("department") == department))
        return rows.select(*plan.columns("deposits" if safe else "bag_id"), "create_user_id")

    return build


for _name, (_part, _department) in _PARTS.items():
    for _safe, _report in ((False, "treasury"), (True, "smartsafe")):
        check(f"rpt_{_report}_{_name}", _branch_sql(_department, _safe))(
            _branch(_safe, _part, _department, DAY)
        )

_STRICT = replace(DAY, strict_keys=True)
for _safe, _report in ((False, "treasury"), (True, "smartsafe")):
    check(f"rpt_{_report}_overshort_strict", _branch_sql("OVER/SHORT", _safe, strict=True))(
        _branch(_safe, "over_short", "OVER/SHORT", _STRICT)
    )


@check("set_union_branches", f"""{_parts(DAY.window, safe=False)}
    select distinct locationid, amount, trans_date, department, billerid, payment_type,
        ref as bag_id, create_user_id
    from branch
""")
def set_union_branches(t):
    merged = plan.treasury_branches(t, DAY).merged()
    return merged.select(*plan.columns("bag_id"), "create_user_id")


@check("rpt_treasury", _report_sql(DAY.window, safe=False))
def rpt_treasury(t):
    return treasury(t, DAY)


@check("rpt_smartsafe_treasury", _report_sql(DAY.window, safe=True))
def rpt_smartsafe_treasury(t):
    return smartsafe_treasury(t, DAY)


_RUN_DATE = ", cast(strptime(trans_date, '%Y%m%d') as date) as report_date"


@check("rpt_backfill_treasury", _report_sql(WEEK.window, False, _RUN_DATE))
def rpt_backfill_treasury(t):
    return backfill("treasury", t, WEEK)


@check("rpt_backfill_smartsafe_treasury", _report_sql(WEEK.window, True, _RUN_DATE))
def rpt_backfill_smartsafe_treasury(t):
    return backfill("smartsafe_treasury", t, WEEK)
