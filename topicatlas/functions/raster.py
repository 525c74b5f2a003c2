"""Pixel coordinates and cluster colours."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the palette: hue is index / count, these two stay the same.
SATURATION = 0.8
BRIGHTNESS = 0.5


def pixel_x(lon: Column, width: int) -> Column:
    return (F.lit(float(width)) * (F.lit(0.5) + lon / 360.0)).cast("int")


def pixel_y(lat: Column, height: int) -> Column:
    return (F.lit(float(height)) * (F.lit(0.5) - lat / 180.0)).cast("int")


def _f32(value: float) -> Column:
    return F.lit(value).cast("float")


def rgb(red: Column, green: Column, blue: Column) -> Column:
    return F.named_struct(F.lit("red"), red, F.lit("green"), green, F.lit("blue"), blue)


def hsb_to_rgb(hue: Column, saturation: float = SATURATION, brightness: float = BRIGHTNESS) -> Column:
    """``struct<red, green, blue>`` of a hue in single precision, channels 0-255."""
    sat, bri, one = _f32(saturation), _f32(brightness), _f32(1.0)
    position = (hue - F.floor(hue).cast("float")) * _f32(6.0)
    sector = F.floor(position)
    rest = position - sector.cast("float")
    low = bri * (one - sat)
    falling = bri * (one - sat * rest)
    rising = bri * (one - sat * (one - rest))

    def channel(*by_sector: Column) -> Column:
        value = F.when(sector == 0, by_sector[0])
        for number, column in enumerate(by_sector[1:], start=1):
            value = value.when(sector == number, column)
        return (value * _f32(255.0) + _f32(0.5)).cast("int")

    return rgb(
        channel(bri, falling, low, low, rising, bri),
        channel(rising, bri, bri, falling, low, low),
        channel(low, low, rising, bri, bri, falling),
    )


def group_color(index: Column, count: Column | int) -> Column:
    """Colour of group ``index`` among ``count`` groups."""
    count = F.lit(count) if isinstance(count, int) else count
    # Spark divides floats in double precision; the cast rounds to the same float.
    return hsb_to_rgb((index.cast("float") / count.cast("float")).cast("float"))


def brighter(color: Column) -> Column:
    """A colour one step brighter (every channel divided by 0.7, at most 255)."""
    black = (color["red"] == 0) & (color["green"] == 0) & (color["blue"] == 0)

    def lift(value: Column) -> Column:
        value = F.when((value > 0) & (value < 3), F.lit(3)).otherwise(value)
        lifted = F.least((value / F.lit(0.7)).cast("int"), F.lit(255))
        return F.when(black, F.lit(3)).otherwise(lifted)

    return rgb(lift(color["red"]), lift(color["green"]), lift(color["blue"]))
