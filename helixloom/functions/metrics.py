"""Column functions on window metrics, alleles and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_WEIGHTS = (0.3, 0.3, 0.4)  # inner distance, tail distance, k-mer ratio


def check_weights(weights: tuple[float, float, float]) -> None:
    """The weights add up to 1, within 1e-9."""
    if abs(sum(weights) - 1) > 1e-9 or min(weights) < 0:
        raise ValueError(f"weights {weights} do not add up to 1")


def gap_distance(gap: Column, k: int) -> Column:
    """Bases between two hits from the number of k-mers missing between them."""
    d = gap - (k - 1)
    return F.when(d > 0, d).otherwise(F.abs(d + 1))


def mean_depth(kmer_count: Column, observed: Column) -> Column:
    return F.when(observed > 0, kmer_count / observed).otherwise(F.lit(0.0))


def score(observed: Column, total: Column, inner: Column, tails: Column, eff_len: Column, weights: tuple[float, float, float] = DEFAULT_WEIGHTS) -> Column:
    """Identity score: 100 for a window that is there whole; below 0 where gaps add up to more than its length."""
    wi, wt, wr = (F.lit(float(w)) for w in weights)
    value = ((wr * (observed / total)) + (wi * (1 - inner / eff_len)) + (wt * (1 - tails / eff_len))) * 100
    return F.when((observed > 0) & (total > 0) & (eff_len > 0), value).otherwise(F.lit(0.0))


def allele(value: Column, a: float = 95, b: float = 60, n: float = 30) -> Column:
    """0 from a on, 2 from b on, -1 up to n, else 1; the first that holds."""
    return F.when(value >= a, 0).when(value >= b, 2).when(value <= n, -1).otherwise(1)


def check_thresholds(a: float, b: float, n: float) -> tuple[float, float, float]:
    """The thresholds, with n taken as 0 where b is 0."""
    if not (0 <= a <= 100 and 0 <= b <= 100 and 0 <= n <= 100):
        raise ValueError("score thresholds are from 0 to 100")
    if a <= b:
        raise ValueError("score a must be greater than score b")
    if b == 0:
        n = 0
    if b < n:
        raise ValueError("score b must not be less than score n")
    return a, b, n


def genotype(code: Column, sep: str = " ") -> Column:
    """The pair of alleles of a code: 0 A A, 2 G G, 1 A G, -1 and any other 0 0."""
    pair = lambda x, y: f"{x}{sep}{y}"
    return F.when(code == 0, pair("A", "A")).when(code == 2, pair("G", "G")).when(code == 1, pair("A", "G")).otherwise(pair("0", "0"))


def hapmap_code(call: Column, alleles: Column) -> Column:
    """0 for the reference allele, 2 for the other one of `alleles` (ref/alt), -1 for N, else 1."""
    pair = F.split(alleles, "/")
    return F.when(call == pair[0], 0).when(call == F.get(pair, F.lit(1)), 2).when(call == "N", -1).otherwise(1)


def ibs_text(ibs: Column) -> Column:
    return F.when(ibs == -1, "N").otherwise(ibs.cast("string"))


def ibs_code(text: Column) -> Column:
    return F.when(text == "N", -1).otherwise(text.cast("int"))


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x.cast("double"))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Closed intervals share a position."""
    return (s1 <= e2) & (s2 <= e1)


def float_cut(x: float) -> Column:
    """A threshold held in single precision and compared in double."""
    return F.lit(float(x)).cast("float").cast("double")
