"""Reading physical plans in tests."""

import re


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node: str) -> int:
    """Plan nodes whose name starts with ``node``; broadcasts are not shuffles."""
    return len(re.findall(rf"(?m)^[ :*+\-|()0-9]*{node}", plan(df)))


def exchanges(df) -> int:
    return count(df, "Exchange ")
