"""Codes the statements look for.  All are configuration; the defaults are the known values."""

from __future__ import annotations

from dataclasses import dataclass


# They have to equal the codes stored in the point-of-sale tables.
@dataclass(frozen=True)
class Codes:
    # tenders
    credit_type: str = "CREDIT_CARD"
    ach_tender: str = "ACH_CHECK"
    cash_tender: str = "USD_CURRENCY"
    cash_type: str = "CURRENCY"
    deposit_label: str = "DEPOSIT"

    # line properties
    posted_amount: str = "CPS_POSTED_TNDR_AMT"
    reversal_link: str = "SPS_REVERSAL_ORIG_TRANS_ID"
    biller: str = "SPECTRUM_BILLER_ID"

    # transaction properties (prefixes)
    deposit_id: str = "SMARTSAFE_DEPOSIT_ID"
    deposit_amount: str = "SMARTSAFE_DEPOSIT_AMT"
    batch_number: str = "CHA_SMARTSAFE_BATCH_NUM"
    kiosk_marker: str = "Kiosk"

    # sale items
    device_item: str = "MOBILEOTD0001"
    service_item: str = "MOBILEOTS0001"
    biller_item: str = "SPECTRUM001"
    non_payable_class: str = "NP"

    # transactions and control transactions
    control_transaction: str = "TENDER_CONTROL"
    complete: str = "COMPLETE"
    new: str = "NEW"
    end_count: str = "ENDCOUNT"
    bank_deposit: str = "BANK_DEPOSIT"
    bag_adjustment: str = "SAFE_BAG_ADJUST"
    change_fund: str = "CHANGEFUND"
    kiosk_repository: str = "KIOSK"
    store_bank: str = "STOREBANK"
    store_bank_label: str = "Store Bank Reconcile"
    bank_deposit_label: str = "Bank Deposit"

    # configuration pushes
    deployment_type: str = "CONFIGURATOR"
    deploy_statuses: tuple[str, ...] = ("COMPLETE", "IN_PROCESS", "SCHEDULED")
    change_type: str = "SYSCFG"
    change_subtype: str = "SystemConfig.xml"
    safe_enabled: str = "SmartSafeEnabled=true"
    scope_prefix: str = "STORE:"
    every_store: str = "*:*"

    # departments
    core: str = "CORE"
    device: str = "MOBILE DEVICE PAYMENT"
    service: str = "MOBILE SERVICE PAYMENT"
    accessory: str = "ACCESSORY"
    over_short: str = "OVER/SHORT"
