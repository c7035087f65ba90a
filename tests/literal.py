"""Point-of-sale tables from literal or random rows, for both engines."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import duckdb
from compare import _plain

from tenderflow.checks.views import with_views
from tenderflow.schemas import DDL, TABLES, schema

DAY = date(2024, 1, 3)


def spark_tables(spark, rows: dict[str, list[tuple]]):
    return {
        name: spark.createDataFrame(rows.get(name, []), schema(name)).coalesce(1)
        for name in TABLES
    }


def duck_tables(rows: dict[str, list[tuple]]):
    connection = duckdb.connect()
    for name, ddl in DDL.items():
        connection.execute(f"create table {name} ({ddl})")
        if rows.get(name):
            marks = ", ".join("?" * len(rows[name][0]))
            connection.executemany(f"insert into {name} values ({marks})", rows[name])
    return connection


def duck_rows(connection, sql: str) -> tuple[list[str], Counter]:
    answer = connection.execute(with_views(sql, given=TABLES))
    names = [column[0] for column in answer.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(_plain(row[i]) for i in order) for row in answer.fetchall())
    return sorted(names), rows


def spark_rows(df) -> tuple[list[str], Counter]:
    order = sorted(df.columns)
    return order, Counter(tuple(_plain(row[name]) for name in order) for row in df.collect())


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value))


def random_rows(seed: int) -> dict[str, list[tuple]]:
    """Rows over tiny domains, so that keys repeat, overlap and miss each other a lot."""
    r = random.Random(seed)
    pick = r.choice
    days = [DAY - timedelta(days=1), DAY, DAY]

    def key():
        return (
            r.choices([1, 2], [5, 1])[0], pick([1, 2, 3]), pick(days), pick([1, 2]),
            pick([1, 2, 3]),
        )

    def near(keys):
        """One of some keys, sometimes with another part."""
        chosen = list(pick(keys))
        if r.random() < 0.2:
            part = r.randrange(5)
            chosen[part] = key()[part]
        return tuple(chosen)

    def moment():
        return datetime.combine(
            r.choices([DAY, DAY - timedelta(days=1), DAY + timedelta(days=1)], [6, 1, 1])[0],
            datetime.min.time(),
        ) + timedelta(minutes=pick([0, 600, 1439]))

    amounts = [None, 0, 5, 10, 12.5, 70, 200, -3]
    tenders = ["USD_CURRENCY", "ACH_CHECK", "VISA", "CHECK", "GIFT"]
    users = [None, 1, 2, 3]
    keys = [key() for _ in range(14)]
    lines = [(*near(keys), pick([1, 2])) for _ in range(24)]
    line_keys = [line[:5] for line in lines]

    def near_line():
        line = pick(lines)
        return (*near([line[:5]]), line[5] if r.random() < 0.8 else pick([1, 2]))

    def reversal():
        org, store, _, till, seq = near(line_keys)
        return pick([
            f"{org}::{store}::D::{till}::{seq}", f"{org}::{store}::D::{till}::{seq}",
            f"{org}::{store}::D::{till}", f"{org}:::{store}::D::{till}::x{seq}", "", None,
        ])

    def line_property():
        code = pick([
            "CPS_POSTED_TNDR_AMT", "CPS_POSTED_TNDR_AMT", "CPS_POSTED_TNDR_AMT_1",
            "CPS_POSTED_TNDR_AMT_2", "CPSXPOSTED_TNDR_AMT_3", "SPECTRUM_BILLER_ID",
            "SPECTRUM_BILLER_ID", "SPS_REVERSAL_ORIG_TRANS_ID", "OTHER",
        ])
        text = {
            "SPECTRUM_BILLER_ID": lambda: pick(["80000001A", "80000001B", "80000002", None, "8"]),
            "SPS_REVERSAL_ORIG_TRANS_ID": reversal,
        }.get(code, lambda: pick(["P1", "P2", None]))()
        return (*near_line(), code, text, money(pick(amounts)))

    def scope():
        return pick(["STORE:1", "STORE:2", "WEST", "STORE:", "OTHER"])

    controls = [near(keys) for _ in range(24)]
    rows = {
        "ttr_tndr_lineitm": [
            (*line, pick(tenders), money(pick(amounts)), moment(), pick(users)) for line in lines
        ],
        "tnd_tndr": [
            (1, "USD_CURRENCY", "CURRENCY"), (1, "ACH_CHECK", pick(["CHECK", "CREDIT_CARD"])),
            (1, "VISA", "CREDIT_CARD"), (1, "CHECK", pick(["CHECK", None])),
            (2, "CHECK", "CHECK"), (2, "USD_CURRENCY", pick([None, "CURRENCY"])),
        ],
        "trl_rtrans_lineitm": [
            (*line, pick([0, 0, 0, 1, None])) for line in lines
        ] + [(*near_line(), 0) for _ in range(4)],
        "trl_rtrans_lineitm_p": [line_property() for _ in range(70)],
        "trl_sale_lineitm": [
            (
                *near(line_keys), pick([1, 2]),
                pick(["MOBILEOTD0001", "MOBILEOTS0001", "ITEM", None]),
                pick(["MOBILEOTS0001", "SPECTRUM001", "SCAN", None]), pick(["NP", "ACC", None]),
            )
            for _ in range(30)
        ],
        "trn_trans": [
            (
                *one, r.choices(["TENDER_CONTROL", "RETAIL_SALE"], [4, 1])[0],
                pick(["COMPLETE", "COMPLETE", "NEW", "SUSPEND"]), pick([1, 2, None]), moment(),
                pick(users),
            )
            for one in [*line_keys, *controls, *[near(keys) for _ in range(6)]]
        ],
        "tsn_session": [(pick([1, 1, 2]), pick([1, 2, 3]), pick([1, 2])) for _ in range(14)],
        "tsn_session_wkstn": [
            (pick([1, 1, 2]), pick([1, 2, 3]), pick([1, 2]), pick([1, 2])) for _ in range(20)
        ],
        "tsn_tndr_control_trans": [
            (
                *one, pick(["ENDCOUNT", "EndCount", "BANK_DEPOSIT", "SAFE_BAG_ADJUST"]),
                pick([None, "STOREBANK", "TILL1", "KIOSK", "KIOSK"]),
                pick(["CHANGEFUND", "CHANGEFUND", "OTHER", None]), pick([1, 2, None]),
                pick([1, 2, 3]), money(pick(amounts)), pick([None, "MISCOUNT"]),
                pick([None, "BAG1", "BAG2", "BAG3"]), moment(), pick(users),
            )
            for one in controls
        ],
        "tsn_tndr_tndr_count": [
            (
                *near(controls), pick(["USD_CURRENCY", "USD_CURRENCY", "CHECK", "GIFT"]),
                pick(["CURRENCY", "CURRENCY", "CHECK"]), money(pick(amounts)), money(pick(amounts)),
                money(pick([None, 0, 1, -1, 2.5])), pick([None, 0, 0, 1, 2]), pick(users),
            )
            for _ in range(30)
        ],
        "trn_trans_p": [
            (
                *near(controls),
                pick([
                    "SMARTSAFE_DEPOSIT_ID_1", "SMARTSAFE_DEPOSIT_ID_2", "SMARTSAFE_DEPOSIT_AMT_1",
                    "SMARTSAFE_DEPOSIT_AMT_2", "CHA_SMARTSAFE_BATCH_NUM_1",
                    "SMARTSAFEXDEPOSIT_ID", "OTHER",
                ]),
                pick(["D9", "D10", "D10", "Kiosk", None]), money(pick(amounts)),
            )
            for _ in range(40)
        ],
        "loc_rtl_loc": [
            (org, store, f"NAME {store}", f"ADDR {store}", "S", "C", "D", "P")
            for org, store in [(1, 1), (1, 2), (2, 2)]
        ],
        "crm_party": [(1, "E1", "Ann", "Lee"), (2, "E2", None, "Ray"), (3, None, None, None)],
        "hrs_employee": [(1, "H1"), (2, "H2")],
        "cfg_profile_element_changes": [
            (
                pick([1, 1, 2]), "STORE", pick(["1", "2"]),
                r.choices(["SYSCFG", "OTHER"], [5, 1])[0],
                r.choices(["SystemConfig.xml", "Other.xml"], [5, 1])[0], pick([1, 2]),
                r.choices(["x SmartSafeEnabled=true y", "SmartSafeEnabled=false", None], [3, 2, 1])[0],
            )
            for _ in range(12)
        ],
        "dpl_deployment": [
            (
                pick([1, 2]), pick(["1", "2"]), "STORE", 
                r.choices(["CONFIGURATOR", "OTHER"], [5, 1])[0],
                pick(["COMPLETE", "IN_PROCESS", "SCHEDULED", "FAILED"]),
                "STORE:*:*" if seed % 4 == 3 else scope(),
            )
            for _ in range(10)
        ],
        "loc_rtl_loc_collection_element": [("WEST", "STORE:3"), ("WEST", "STORE:1")],
    }
    noted = {one[1:]: one for one in controls}
    rows["trn_trans_notes"] = [
        (*one, f"note {n % 3}") for n, one in enumerate(noted.values()) if n % 2
    ]
    return rows
