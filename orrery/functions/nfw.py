"""The NFW density profile, and its fit to binned densities."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame


def _m(c):
    return np.log(1 + c) - c / (1 + c)


@dataclass(frozen=True)
class NFW:
    """rho(r) = rho_s / ((r / r_s) (1 + r / r_s)^2)."""

    rho_s: float
    r_s: float
    halo_radius: float | None = None

    @classmethod
    def of_mass(cls, mass: float, radius: float, concentration: float) -> NFW:
        r_s = radius / concentration
        return cls(mass / (4 * math.pi * r_s**3 * float(_m(concentration))), r_s, radius)

    @classmethod
    def of_density_at_scale(cls, density: float, r_s: float, radius: float | None = None) -> NFW:
        return cls(4 * density, r_s, radius)

    @property
    def concentration(self) -> float:
        if self.halo_radius is None:
            raise ValueError("no halo radius")
        return self.halo_radius / self.r_s

    def density(self, r):
        x = np.asarray(r, float) / self.r_s
        return self.rho_s / (x * (1 + x) ** 2)

    def enclosed(self, r):
        return 4 * math.pi * self.rho_s * self.r_s**3 * _m(np.asarray(r, float) / self.r_s)

    def slope(self, r):
        """d log rho / d log r."""
        x = np.asarray(r, float) / self.r_s
        return -(1 + 3 * x) / (1 + x)

    @classmethod
    def fit(cls, r, density, error=None, steps: int = 200) -> NFW:
        """Least squares in the logarithms of rho_s and r_s, with the analytic Jacobian
        and a damping that follows the progress."""
        r, d = np.asarray(r, float), np.asarray(density, float)
        w = 1 / np.asarray(error, float) if error is not None else 1 / np.maximum(d, 1e-300)
        p = np.array([math.log(float(np.median(d)) * 4), math.log(float(np.median(r)))])
        damp, cost = 1e-2, np.inf

        def residual(p):
            return (cls(math.exp(p[0]), math.exp(p[1])).density(r) - d) * w

        cost = float((residual(p) ** 2).sum())
        for _ in range(steps):
            f = cls(math.exp(p[0]), math.exp(p[1]))
            rho = f.density(r)
            jac = np.stack([rho, -f.slope(r) * rho], axis=1) * w[:, None]
            res = residual(p)
            a = jac.T @ jac
            step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-300)), -jac.T @ res)
            new = p + np.clip(step, -2, 2)
            c = float((residual(new) ** 2).sum())
            if c <= cost:
                done = cost - c <= 1e-14 * cost and np.abs(step).max() < 1e-10
                p, cost, damp = new, c, max(damp / 5, 1e-12)
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        return cls(math.exp(p[0]), math.exp(p[1]))

    @classmethod
    def fit_table(cls, table: DataFrame, r: str = "rbins", density: str = "density") -> NFW:
        """A fit to a profile's bins; empty ones are left out."""
        rows = [(a, b) for a, b in table.select(r, density).collect() if b]
        return cls.fit([a for a, _ in rows], [b for _, b in rows])
