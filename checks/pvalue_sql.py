"""p-values in SQL, by Simpson's rule over the tail of the density: a form of its own beside ``functions/pvalues.py``."""
from __future__ import annotations

STEPS = 2000


def integral(f: str, low: str, high: str) -> str:
    """Integral of ``f`` in ``{x}`` from ``low`` to ``high``, all SQL expressions."""
    at = f"(({low}) + (({high}) - ({low})) * i / {STEPS}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {weight} * {f.format(x=at)})) * (({high}) - ({low})) / {3 * STEPS}.0)"


def normal(z: str) -> str:
    """Two-sided."""
    return f"(2 / sqrt(2 * pi()) * {integral('exp(-0.5 * {x} * {x})', f'abs({z})', f'abs({z}) + 12')})"


def student(t: str, df: str) -> str:
    """Two-sided; t = sqrt(df) tan(x) makes the density a power of the cosine."""
    tail = integral(f"pow(cos({{x}}), ({df}) - 1)", f"atan(abs({t}) / sqrt({df}))", "pi() / 2")
    return f"(2 / sqrt(pi()) * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) * {tail})"


def chi2(x: str, df: str) -> str:
    """Upper tail, over the square root of x."""
    tail = integral(f"pow({{x}}, ({df}) - 1) * exp(-0.5 * {{x}} * {{x}})", f"sqrt({x})", f"sqrt({x}) + 14")
    return f"(2 * {tail} / (pow(2, ({df}) / 2.0) * gamma(({df}) / 2.0)))"


def student_975(df: str) -> str:
    """Quantile by the expansion in 1 / df; good to seven digits from 20 degrees of freedom."""
    z = "1.959963984540054e0"
    terms = (
        f"({z} + (pow({z}, 3) + {z}) / 4 / d + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / 96 / d / d"
        f" + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / 384 / d / d / d"
        f" + (79 * pow({z}, 9) + 776 * pow({z}, 7) + 1482 * pow({z}, 5) - 1920 * pow({z}, 3) - 945 * {z}) / 92160 / d / d / d / d)"
    )
    return terms.replace("/ d", f"/ CAST({df} AS DOUBLE)")
