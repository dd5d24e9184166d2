from __future__ import annotations


#: Amounts whose 20-bit parts a bigint can hold the sum of.
MOST_ROWS = 2**43


def quoted(column: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + column.replace("`", "``") + "`"


def hundredths(column: str) -> str:
    """SQL for a double amount in whole hundredths: `CAST(x AS DECIMAL(18,2)) * 100` as bigint.

    Casting a double to a decimal prints and parses every value. An amount that already has
    two decimals needs none of that: rounding `x * 100` gives its hundredths, and dividing
    back to the same double proves it (below 1e13, where doubles hold all two-decimal
    amounts apart). All other values take the cast. Nulls stay null. Values the cast cannot
    hold (NaN, infinities, 1e16 and above) raise an error whether or not the session is in
    ANSI mode, so that no row drops out of a sum unseen.

    SQL text, since building it from `Column` calls costs a driver round trip per operator.
    """
    x = quoted(column)
    return f"""
        CASE
            WHEN {x} IS NULL THEN NULL
            WHEN abs({x}) < 1e13D AND rint({x} * 100) / 100 = {x} THEN CAST(rint({x} * 100) AS BIGINT)
            ELSE coalesce(
                CAST(CAST({x} AS DECIMAL(18,2)) * 100 AS BIGINT),
                raise_error('amount does not fit decimal(18,2): ' || {x})
            )
        END"""


def exact_total(amount: str) -> str:
    """SQL for the sum of a column of hundredths, as decimal(38,2) of whole units.

    Each value, below 2**60, is added up in three 20-bit parts. A bigint holds the sum of
    2**43 such parts (8.8e12), so nothing overflows even with every row of 100 TB in one group.
    A group with more amounts raises an error, in ANSI mode or not.
    """
    x = quoted(amount)
    total = f"""
        CAST((
            CAST(sum({x} & 1048575) AS DECIMAL(19,0))
            + CAST(sum(shiftright({x}, 20) & 1048575) AS DECIMAL(19,0)) * 1048576
            + CAST(sum(shiftright({x}, 40)) AS DECIMAL(19,0)) * 1099511627776
        ) * 0.01BD AS DECIMAL(38,2))"""
    return within_rows(total, f"count({x})")


def within_rows(total: str, rows: str) -> str:
    """SQL for `total`, or an error where `rows` exceeds what the part sums can hold."""
    return f"""
        CASE WHEN {rows} <= {MOST_ROWS} THEN {total}
        ELSE raise_error('more than 2**43 amounts in a group') END"""
