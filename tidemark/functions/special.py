"""Functions that Spark's SQL lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def student_t_log_density(x: Column, nu: float, scale: float = 1.0) -> Column:
    """ln of the density; the gamma functions depend on ``nu`` only, so they are constants and all stays in the JVM."""
    head = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(scale)
    z = x / scale
    return F.lit(head) - F.lit((nu + 1) / 2) * F.ln(1 + z * z / nu)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function, for arguments that are not constant: Arrow batches."""

    @F.pandas_udf("double")
    def lgamma(v: pd.Series) -> pd.Series:
        return pd.Series(np.array([math.lgamma(a) if a == a and not (a <= 0 and a == int(a)) else np.nan for a in v.to_numpy(float)]))

    return lgamma(x)


def log_sum_exp(xs: Column) -> Column:
    """Of an array of doubles, without overflow."""
    top = F.array_max(xs)
    return top + F.ln(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def bare_name(c: Column) -> Column:
    """A name as a label, without the words of companies' forms."""
    from tidemark.functions.text import label

    return F.array_join(F.filter(F.split(label(F.coalesce(c, F.lit(""))), " "), lambda w: ~w.isin(*COMMON_WORDS)), " ")


def matched_ratio(a: Column, b: Column) -> Column:
    """The Ratcliff-Obershelp ratio of two strings: a Python function, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return ratio(a, b)


def name_similarity(a: Column, b: Column) -> Column:
    """The ratio of two names' bare forms."""
    return matched_ratio(bare_name(a), bare_name(b))


#: Words that tell companies' forms, not their names.
COMMON_WORDS = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "sa", "ag", "nv", "class", "ordinary", "shares", "the"]
