"""Column expressions: every function takes and returns Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import col

# Fixed physical values used by the flow and wind formulas.
VON_KARMAN = 0.4
GRAVITY = 9.81
GAS_CONSTANT_DRY_AIR = 287.05
HEAT_CAPACITY_DRY_AIR = 1004.0
KM_PER_DEGREE = 111.0
DATENUM_OF_UNIX_EPOCH = 719529


def speed(u, v, w=None) -> Column:
    """Length of a velocity vector."""
    total = col(u) * col(u) + col(v) * col(v)
    if w is not None:
        total = total + col(w) * col(w)
    return F.sqrt(total)


def nondim_time(t, velocity: float, length: float, offset: float = 0.0) -> Column:
    """Convective time t*U/L, shifted by ``offset``."""
    return col(t) * velocity / length + offset


def force_coeff(force, density: float, velocity: float, area: float) -> Column:
    """Force over dynamic pressure times area."""
    return col(force) / (0.5 * density * velocity * velocity * area)


def stderr(sd, n) -> Column:
    """Standard error of a mean; NULL for an empty group."""
    return F.when(col(n) > 0, col(sd) / F.sqrt(col(n)))


def wrap360(angle) -> Column:
    """Angle in [0, 360]; positive multiples of 360 stay 360."""
    a = col(angle)
    m = F.pmod(a, F.lit(360.0))
    return F.when((m == 0) & (a > 0), F.lit(360.0)).otherwise(m)


def wrap180(angle) -> Column:
    """Angle in [-180, 180]; odd multiples of 180 keep the sign of the input."""
    a = col(angle)
    return F.when(F.abs(a) <= 180, a).otherwise(wrap360(a + 180.0) - 180.0)


def angle_diff(a, b) -> Column:
    """Signed smallest rotation from ``a`` to ``b`` in degrees."""
    return wrap180(col(b) - col(a))


def wind_components(wind_speed, direction) -> tuple[Column, Column]:
    """(u, v) of a wind whose direction says where it comes *from*."""
    rad = F.radians(col(direction))
    return -col(wind_speed) * F.cos(rad), -col(wind_speed) * F.sin(rad)


def ratio_column(a, b) -> Column:
    """a/b, NULL where b is 0."""
    return F.when(col(b) != 0, col(a) / col(b))


def power_coefficient(power, wind_speed, density: float, radius: float) -> Column:
    """Share of the wind's power that is extracted; negative values are invalid."""
    swept = 0.5 * density * math.pi * radius * radius
    cp = col(power) / (swept * F.pow(col(wind_speed), 3))
    return F.when(cp >= 0, cp)


def tip_speed_ratio(rotor, wind_speed, radius: float) -> Column:
    return ratio_column(col(rotor) * radius, wind_speed)


def polar_to_uv(magnitude, angle) -> tuple[Column, Column]:
    rad = F.radians(col(angle))
    return col(magnitude) * F.cos(rad), col(magnitude) * F.sin(rad)


# Fixed order of the exponents (i, j) of e1^i * e2^j in the calibration polynomial.
POLY5_EXPONENTS = (
    (0, 0),
    (1, 0), (0, 1),
    (2, 0), (0, 2), (1, 1),
    (3, 0), (0, 3), (1, 2), (2, 1),
    (4, 0), (0, 4), (1, 3), (3, 1), (2, 2),
    (5, 0), (0, 5), (1, 4), (4, 1), (2, 3), (3, 2),
)


def _power(c: Column, n: int) -> Column:
    out = c
    for _ in range(n - 1):
        out = out * c
    return out


def poly5_terms(e1, e2) -> list[Column]:
    """The 21 monomials up to degree five as separate columns."""
    terms = []
    for i, j in POLY5_EXPONENTS:
        parts = [_power(col(c), n) for c, n in ((e1, i), (e2, j)) if n]
        term = F.lit(1.0)
        if parts:
            term = parts[0] if len(parts) == 1 else parts[0] * parts[1]
        terms.append(term)
    return terms


def poly5_features(e1, e2) -> Column:
    """The 21 monomials up to degree five as one array."""
    return F.array(*poly5_terms(e1, e2))


def pressure_at(base_pressure, height, temperature) -> Column:
    """Hydrostatic pressure ``height`` metres above the barometer (falls with height, K)."""
    p0 = col(base_pressure)
    return p0 - col(height) * GRAVITY * p0 / (GAS_CONSTANT_DRY_AIR * col(temperature))


def virtual_potential_temperature(temperature, pressure, reference: float = 81100.0) -> Column:
    exponent = 287.0 / HEAT_CAPACITY_DRY_AIR
    return col(temperature) * F.pow(F.lit(reference) / col(pressure), exponent)


def datenum_to_ts(datenum, zone: str | None = None) -> Column:
    """Day count from year 0 (UTC) to a timestamp, optionally shown in ``zone``.

    A day count holds about ten microseconds; it is rounded to milliseconds.
    """
    micros = F.floor((col(datenum) - DATENUM_OF_UNIX_EPOCH) * 86400e3 + 0.5).cast("bigint") * 1000
    ts = F.timestamp_micros(micros)
    return F.from_utc_timestamp(ts, zone) if zone else ts


def businger_dyer_psi(z, obukhov) -> Column:
    """Stability correction of the wind profile, unstable branch (L < 0)."""
    x = F.pow(1 - 15.0 * col(z) / col(obukhov), 0.25)
    psi = (
        -2 * F.log((1 + x) / 2) - F.log(1 + x * x) + 2 * F.atan(x) - math.pi / 2
    )
    return F.when(col(obukhov) < 0, psi)


def shear(z, obukhov, friction) -> Column:
    """Unstable wind shear u*/(kz) * (1 - 15 z/L)^(-1/4)."""
    factor = F.pow(1 - 15.0 * col(z) / col(obukhov), -0.25)
    return F.when(col(obukhov) < 0, col(friction) / (VON_KARMAN * col(z)) * factor)
