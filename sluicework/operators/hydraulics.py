"""Hydraulic formulas as column expressions: metres of water, litres a second, kilowatts, hertz."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed physical values: gravity, water's density, pressure, heat capacity, temperature, molar mass, gas constant.
G, RHO, P0, CP, T0, MOLAR, GAS = 9.80665, 997.8, 101325.0, 1004.68506, 293.15, 0.02896968, 8.314462618
#: Exponent of the efficiency's change with speed.
ETA_EXPONENT = -0.1


def system_head(q: Column, qref: Column, href: Column, static: Column) -> Column:
    return static + (href - static) * F.pow(q / qref, F.lit(2.0))


def atmospheric_head(altitude: Column) -> Column:
    """Null beyond the model's range."""
    base = 1 - G * altitude / (CP * T0)
    return F.when(base > 0, P0 / (G * RHO) * F.pow(base, F.lit(CP * MOLAR / GAS)))


def scaled_efficiency(eta: Column, ratio: Column) -> Column:
    return F.when(eta == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (1 - eta) * F.pow(ratio, F.lit(ETA_EXPONENT)))))


def slip(poles: Column, base_freq: Column, base_speed: Column) -> Column:
    return 1 - base_speed * poles / (120 * base_freq)


def ratio_of_frequency(f: Column, base_freq: Column, s: Column) -> Column:
    y = f / base_freq
    return F.when(1 - s + y * s > 0, y / (1 - s + y * s))


def frequency_of_ratio(r: Column, poles: Column, base_speed: Column, s: Column) -> Column:
    return F.when(1 - s * r > 0, base_speed * r / (1 - s * r) * poles / 120)


def shaft_power(q: Column, h: Column, eta: Column) -> Column:
    """Null without efficiency."""
    return F.when(eta > 0, 1e-3 * q * 0.9978 * G * h / eta)


def npsh_status(required: Column, available: Column, least: float = 0.6, ratio: float = 1.25) -> Column:
    good = (available - required >= least) & ((required == 0) | (available / F.nullif(required, F.lit(0.0)) >= ratio))
    return F.when(required.isNull(), "not_available").when(good, "approved").otherwise("rejected")


def head_loss(q: Column, diameter: Column, roughness: float = 0.26e-3, viscosity: float = 1.0e-6) -> tuple[Column, Column]:
    """(velocity, loss for 100 m) by Darcy-Weisbach with an explicit friction factor."""
    v = q / 1000 / (F.pi() * diameter * diameter / 4)
    friction = 0.25 / F.pow(F.log10(roughness / (3.7 * diameter) + 5.74 / F.pow(v * diameter / viscosity, F.lit(0.9))), F.lit(2.0))
    return v, friction / diameter * v * v / (2 * G) * 100
