"""Special functions as SQL expressions, the same text for Spark and for other SQL engines."""

from __future__ import annotations

#: Coefficients of the public rational approximation of the normal quantile (relative error below 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
#: The public polynomial approximation of erf (absolute error below 1.5e-7).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _horner(coefficients, x: str, last: bool = False) -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return f"({out} * {x} + {_number(1.0)})" if last else out


def normal_quantile(p: str) -> str:
    """The standard normal quantile of the expression p in (0, 1)."""
    low, high = _number(0.02425), _number(0.97575)
    q = f"sqrt(-2 * ln({p}))"
    u = f"sqrt(-2 * ln(1 - {p}))"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return (
        f"CASE WHEN {p} < {low} THEN {_horner(_C, q)} / {_horner(_D, q, True)} "
        f"WHEN {p} > {high} THEN -({_horner(_C, u)} / {_horner(_D, u, True)}) "
        f"ELSE {_horner(_A, r)} * ({p} - 0.5) / {_horner(_B, r, True)} END"
    )


def normal_density(x: str) -> str:
    return f"(exp(-0.5 * ({x}) * ({x})) * {_number(0.3989422804014327)})"


def two_sided_p(z: str) -> str:
    """P(|Z| > |z|) of a standard normal."""
    x = f"(abs({z}) / sqrt({_number(2.0)}))"
    t = f"({_number(1.0)} / ({_number(1.0)} + {_number(0.3275911)} * {x}))"
    return f"({_horner(_ERF[::-1], t)} * {t} * exp(-({x} * {x})))"


def chisq2_p(x: str) -> str:
    """Upper tail of a chi-square of two degrees of freedom."""
    return f"exp(-({x}) / 2)"
