"""Re-estimation algorithms for missing cells."""

from .bayes import BPCA
from .completion import ALM, SVT
from .donors import PCADA
from .engine import Fit, fit, fitted_values
from .factors import ALS, Alternating, SVDImpute
from .probabilistic import PPCA, PPCAM

# Column means ("MI") need no fit; see rowmend.operators.gaps.impute_mean.
ALGORITHMS = {
    "Alternating": Alternating, "SVDImpute": SVDImpute, "PCADA": PCADA, "PPCA": PPCA,
    "PPCA-M": PPCAM, "BPCA": BPCA, "SVT": SVT, "ALM": ALM, "ALS": ALS,
}

__all__ = ["ALGORITHMS", "ALM", "ALS", "BPCA", "Alternating", "Fit", "PCADA", "PPCA", "PPCAM",
           "SVDImpute", "SVT", "fit", "fitted_values"]
