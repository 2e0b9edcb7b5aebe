"""Writing monthly balances back into a register."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnResolutionError
from ..functions import ORD, as_text, canonical_id, col, parse_balance, strip, whole_units
from .columns import (
    ACCOUNT_ALIASES,
    BALANCE_ALIASES,
    TYPE_ALIASES,
    resolve_alias,
    target_column,
)
from .joins import JoinPolicy, left_lookup
from .lookup import row_order

# Fixed value: accounts of this type are never updated.
SKIPPED_TYPE = "deposito"

_KEY, _BALANCE, _STATE = "_account", "_balance", "_state"


def pick_balances(tables: Sequence[tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
    """The first table with an account and a balance column."""
    for name, frame in tables:
        if resolve_alias(frame.columns, ACCOUNT_ALIASES) and resolve_alias(
            frame.columns, BALANCE_ALIASES
        ):
            return name, frame
    looked_at = "\n".join(f"  {name}: {frame.columns}" for name, frame in tables)
    raise ColumnResolutionError(
        f"no monthly table has an account and a balance column.\nTables looked at:\n{looked_at}\n"
        f"Accepted headers:\n  account: {list(ACCOUNT_ALIASES)}\n  balance: {list(BALANCE_ALIASES)}"
    )


def monthly_balances(monthly: DataFrame, order_by: str | None = None) -> DataFrame:
    """``account, balance``: the first *numeric* balance of each canonical account.

    Cells that are no plain number have no place in the order, so they are never first;
    a filter on them would be pushed down and parse each cell again. State per account is
    two numbers, so it aggregates by hash.
    """
    _, monthly = pick_balances([("monthly", monthly)])
    account = resolve_alias(monthly.columns, ACCOUNT_ALIASES)
    balance = resolve_alias(monthly.columns, BALANCE_ALIASES)
    pairs = monthly.select(
        canonical_id(as_text(monthly, account)).alias("account"),
        parse_balance(col(balance), monthly.schema[balance].dataType).alias("balance"),
        row_order(monthly, order_by).alias(ORD),
    )
    account_ok = (
        F.col("account").isNotNull() & (F.col("account") != "") & (F.lower("account") != "nan")
    )
    numeric_order = F.when(F.col("balance").isNotNull(), F.col(ORD))
    first = pairs.where(account_ok).groupBy("account").agg(
        F.min_by("balance", numeric_order).alias("balance")
    )
    return first.where(F.col("balance").isNotNull())


@dataclass(frozen=True)
class Reconciled:
    """A register after the write-back, and which column took the balances."""

    rows: DataFrame
    target: str

    @property
    def register(self) -> DataFrame:
        """Every register row, in the register's own columns."""
        return self.rows.drop(_KEY, _BALANCE, _STATE)

    def counts(self) -> DataFrame:
        """One row: accounts scanned (skipped ones included), unmatched, updated."""
        s = F.col(_STATE)
        return self.rows.agg(
            F.count_if(s != "blank").alias("scanned_rows"),
            F.count_if(s == "unmatched").alias("unmatched_rows"),
            F.count_if(s == "updated").alias("updated_rows"),
        )


def write_back(
    register: DataFrame,
    monthly: DataFrame,
    order_by: str | None = None,
    policy: JoinPolicy = JoinPolicy(),
) -> Reconciled:
    """Put each account's monthly balance, in whole units, into the register.

    Skipped, unmatched and blank rows keep what they had: nothing is ever blanked.
    """
    account = resolve_alias(register.columns, ACCOUNT_ALIASES)
    if account is None:
        raise ColumnResolutionError(
            f"the register has no account column. Available columns: {register.columns}. "
            f"Accepted headers: {list(ACCOUNT_ALIASES)}"
        )
    kind = resolve_alias(register.columns, TYPE_ALIASES)
    target = target_column(register.columns)

    balances = monthly_balances(monthly, order_by).select(
        F.col("account").alias(_KEY), F.col("balance").alias(_BALANCE)
    )
    keyed = register.withColumn(
        _KEY, F.coalesce(canonical_id(as_text(register, account)), F.lit(""))
    )
    joined = left_lookup(keyed, balances, _KEY, policy)
    skipped = (
        F.coalesce(F.lower(strip(as_text(register, kind))) == SKIPPED_TYPE, F.lit(False))
        if kind
        else F.lit(False)
    )
    state = (
        F.when(F.col(_KEY) == "", F.lit("blank"))
        .when(skipped, F.lit("skipped"))
        .when(F.col(_BALANCE).isNull(), F.lit("unmatched"))
        .otherwise(F.lit("updated"))
    )
    new = whole_units(F.col(_BALANCE))
    if target in register.columns:
        old, held = col(target), register.schema[target].dataType
        out = held if isinstance(held, (T.StringType, T.NumericType)) else T.LongType()
    else:
        old, out = F.lit(None), T.LongType()
    updated = F.when(F.col(_STATE) == "updated", new.cast(out)).otherwise(old.cast(out))
    rows = joined.withColumn(_STATE, state).withColumn(target, updated)
    names = [*register.columns, *([] if target in register.columns else [target])]
    return Reconciled(rows.select(*map(col, names), _KEY, _BALANCE, _STATE), target)
