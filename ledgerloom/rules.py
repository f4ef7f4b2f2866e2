"""Account rules as data: which accounts, document types and rates feed each workpaper."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class LedgerRules:
    # Account names, prefixes, codes and document types of the ledger.
    payable_pattern: str = "应付账款"
    receivable_pattern: str = "应收账款"
    finance_pattern: str = "财务费用"
    payable_prefix: str = "2202"
    accrued_prefix: str = "2251"
    other_receivable_prefix: str = "1231"
    other_payable_prefix: str = "2241"
    intangible_class_prefix: str = "Z8"
    intangible_account: str = "1701"
    accrual_account: str = "22026000"
    gl_adjustment_account: str = "22029000"
    neg_reclass_account: str = "22029900"
    fx_account: str = "22028900"
    receivable_fx_accounts: tuple[str, ...] = ("11220010", "11220030", "11220050")
    payable_increase_types: tuple[str, ...] = ("OA", "RE")
    receivable_increase_type: str = "RV"
    clearing_type: str = "SA"
    debit_flag: str = "S"
    credit_flag: str = "H"
    base_currency: str = "CNY"
    vat_divisor: Decimal = Decimal("1.13")

    # Oddities of the published workpapers, kept by default so that results agree.
    # Each can be turned off on its own.
    fx_control_uses_plain_reclass: bool = True
    receivable_sign_test_ignores_fx: bool = True
    adjusted_control_unaudited_zero: bool = True
    adjusted_fx_advance_uses_plain: bool = True

    # Payables of a code with several names pair up across sources, as published: n names in one
    # and m in another give n * m rows. With names in the key each name is a row of its own, so
    # that a code with very many names stays small; `name_pairs` shows the codes concerned.
    party_names_in_key: bool = False
