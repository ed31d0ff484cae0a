"""Sun geometry as column arithmetic (low-precision almanac formulas, good to some hundredths of a degree)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Default site.
LATITUDE, LONGITUDE = 35.665, -78.495


def _sun(ts: Column) -> tuple[Column, Column]:
    """Declination (radians) and equation of time (minutes) at a UTC timestamp."""
    t = (F.unix_micros(ts) / 86400e6 + 2440587.5 - 2451545.0) / 36525.0
    mean_long = F.radians(F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0)))
    anomaly = F.radians(357.52911 + t * (35999.05029 - t * 0.0001537))
    eccentric = 0.016708634 - t * (0.000042037 + t * 0.0000001267)
    center = F.sin(anomaly) * (1.914602 - t * (0.004817 + t * 0.000014)) + F.sin(2 * anomaly) * (0.019993 - t * 0.000101) + F.sin(3 * anomaly) * 0.000289
    node = F.radians(125.04 - 1934.136 * t)
    apparent = F.radians(F.degrees(mean_long) + center - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * F.cos(node))
    y = F.pow(F.tan(tilt / 2), 2)
    time = 4 * F.degrees(
        y * F.sin(2 * mean_long) - 2 * eccentric * F.sin(anomaly) + 4 * eccentric * y * F.sin(anomaly) * F.cos(2 * mean_long)
        - 0.5 * y * y * F.sin(4 * mean_long) - 1.25 * eccentric * eccentric * F.sin(2 * anomaly)
    )
    return F.asin(F.sin(tilt) * F.sin(apparent)), time


def elevation(ts: Column, latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """True elevation (degrees) and hour angle (radians)."""
    declination, equation = _sun(ts)
    minutes = F.pmod(F.unix_micros(ts) / 60e6, F.lit(1440.0))
    hour = F.radians(F.pmod(minutes + equation + 4 * longitude, F.lit(1440.0)) / 4 - 180.0)
    lat = F.radians(latitude)
    return F.degrees(F.asin(F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(hour))), hour


def solar_position(ts: Column, latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Zenith (corrected for refraction) and azimuth (clockwise from north), in degrees."""
    declination, _ = _sun(ts)
    height, hour = elevation(ts, latitude, longitude)
    lat = F.radians(latitude)
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(lat) - F.tan(declination) * F.cos(lat))) + 180.0, F.lit(360.0))
    refraction = F.when(height > -0.575, 1.02 / 60.0 / F.tan(F.radians(height + 10.3 / (height + 5.11)))).otherwise(0.0)
    return 90.0 - height - refraction, azimuth


def minutes_from_noon(ts: Column, longitude: Column, zone: str, latitude: Column | None = None) -> Column:
    """Distance, in minutes, from the minute of the local day in which the sun stands highest (the first, if two do).

    No day's grid has to be searched: the sun crosses the meridian at a time that follows
    from the equation of time at midday, and only the minutes around it are compared.
    """
    midnight = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)
    start = F.unix_micros(midnight) / 60e6
    _, equation = _sun(midnight + F.expr("interval 12 hours"))
    noon = F.round(F.pmod(720.0 - 4 * longitude - equation - F.pmod(start, F.lit(1440.0)), F.lit(1440.0)))
    lat = F.lit(LATITUDE) if latitude is None else latitude
    height = lambda minute: elevation(F.timestamp_micros((minute * 60e6).cast("long")), lat, longitude)[0]
    # an array of one, so that the crossing is worked out once for all its neighbours
    highest = F.transform(F.array(start + noon), lambda m: F.array_max(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.struct(height(m + i).alias("height"), (-m - i).alias("minute")))))
    return F.abs(F.unix_micros(ts) / 60e6 + highest[0]["minute"])


def shadow_row_angle(sun_azimuth: Column, row_azimuth: Column) -> Column:
    """Angle between shadow and row, 0 to 90 degrees."""
    d = F.abs(F.pmod(sun_azimuth + 180.0, F.lit(180.0)) - row_azimuth)
    return F.when(d.isNotNull(), F.least(d, 180.0 - d))
