"""Special functions and evidential heads as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EPS = 1e-6


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def lgamma(x: Column) -> Column:
    """log of gamma for x > 0: shift by 8, then Stirling's series (error under 1e-11)."""
    y = x + 8
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - shift


def digamma(x: Column) -> Column:
    """Derivative of lgamma for x > 0, by the same shift."""
    y = x + 8
    shift = sum((1 / (x + k) for k in range(1, 8)), 1 / x)
    return F.log(y) - 0.5 / y - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - 1 / (252 * y * y * y * y * y * y) - shift


def nig_head(raw: list[Column]) -> dict[str, Column]:
    """Normal-inverse-gamma parameters and uncertainties from four raw outputs."""
    nu, alpha, beta = softplus(raw[1]) + EPS, softplus(raw[2]) + 1 + EPS, softplus(raw[3]) + EPS
    return {"gamma": raw[0], "nu": nu, "alpha": alpha, "beta": beta, "aleatoric": beta / (alpha - 1), "epistemic": beta / (nu * (alpha - 1))}


def nig_nll(y: Column, gamma: Column, nu: Column, alpha: Column, beta: Column) -> Column:
    omega = 2 * beta * (1 + nu)
    return 0.5 * F.log(math.pi / nu) - alpha * F.log(omega) + (alpha + 0.5) * F.log((y - gamma) * (y - gamma) * nu + omega) + lgamma(alpha) - lgamma(alpha + 0.5)


def nig_regulariser(y: Column, gamma: Column, nu: Column, alpha: Column) -> Column:
    return F.abs(y - gamma) * (2 * nu + alpha)


def dirichlet_head(raw: list[Column]) -> tuple[list[Column], list[Column], Column]:
    """(alpha, probabilities, uncertainty) from one raw output per class."""
    alpha = [softplus(x) + 1 for x in raw]
    total = sum(alpha[1:], alpha[0])
    return alpha, [a / total for a in alpha], len(raw) / total


def dirichlet_digamma_loss(alpha: list[Column], truth: list[Column]) -> Column:
    total = sum(alpha[1:], alpha[0])
    return sum((t * (digamma(total) - digamma(a)) for t, a in zip(truth, alpha)), F.lit(0.0))


def dirichlet_kl(alpha: list[Column], truth: list[Column]) -> Column:
    """Divergence from the uniform Dirichlet after the evidence for the right class is taken out."""
    a = [t + (1 - t) * x for t, x in zip(truth, alpha)]
    total = sum(a[1:], a[0])
    spread = sum(((x - 1) * (digamma(x) - digamma(total)) for x in a), F.lit(0.0))
    return lgamma(total) - sum((lgamma(x) for x in a), F.lit(0.0)) - math.lgamma(len(alpha)) + spread


def wsd_factor(step: Column, total: int, warmup: int, decay: int) -> Column:
    """Learning-rate factor: linear rise, level, cosine fall to zero."""
    start = total - decay
    fall = 0.5 * (1 + F.cos(math.pi * (step - start) / max(1, decay)))
    return F.when(step < warmup, step / max(1, warmup)).when(step < start, F.lit(1.0)).when(step >= total, F.lit(0.0)).otherwise(fall)
