"""Row and column security as data operators. The principal is an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.joins import semi_join


def _principal(principal: str | None) -> Column:
    return F.current_user() if principal is None else F.lit(principal)


def rls_direct(df: DataFrame, column: str, principal: str | None = None) -> DataFrame:
    """Rows whose column names the principal."""
    return df.where(F.col(column) == _principal(principal))


def rls_mapping(
    df: DataFrame,
    column: str,
    mapping: DataFrame,
    principal: str | None = None,
    user_column: str = "username",
    value_column: str | None = None,
) -> DataFrame:
    """Rows whose value the mapping table allows the principal."""
    allowed = mapping.where(F.col(user_column) == _principal(principal))
    return semi_join(df, allowed, {column: value_column or column})


def is_admin(admins: DataFrame, principal: str | None = None, user_column: str = "username") -> bool:
    """Whether the override table lists the principal: one bounded look-up."""
    return not admins.where(F.col(user_column) == _principal(principal)).isEmpty()


def rls_admin_bypass(
    df: DataFrame,
    column: str,
    mapping: DataFrame,
    admins: DataFrame,
    principal: str | None = None,
    user_column: str = "username",
    value_column: str | None = None,
) -> DataFrame:
    """Like ``rls_mapping``, but principals in the override table see all rows."""
    if is_admin(admins, principal, user_column):
        return df
    return rls_mapping(df, column, mapping, principal, user_column, value_column)


def ols_column_omit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """View for a role that must not see that the columns exist."""
    return df.drop(*columns)


def column_mask(df: DataFrame, columns: Sequence[str], masked: bool | Column = True, mask: str | None = "***") -> DataFrame:
    """Show a mask (or NULL) instead of the value while ``masked`` holds."""
    condition = masked if isinstance(masked, Column) else F.lit(masked)
    return df.withColumns(
        {c: F.when(condition, F.lit(mask).cast("string")).otherwise(F.col(c).cast("string")) for c in columns}
    )
