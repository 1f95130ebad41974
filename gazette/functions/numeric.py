"""Number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of movements, size of sparklines.
COLORS = {"up": "#ef4444", "down": "#3b82f6", "flat": "#8890a3"}
WIDTH, HEIGHT, PAD = 84, 28, 3


def round_half_up(c: Column, places: int = 2) -> Column:
    """The same on every engine: floor(x * 10^n + 0.5) / 10^n."""
    return F.floor(c * 10**places + 0.5) / 10**places


def pct_change(latest: Column, past: Column) -> Column:
    """Per cent; null where there is nothing to compare with."""
    return F.when(past != 0, (latest - past) / past * 100)


def direction(pct: Column) -> Column:
    return F.when(pct > 0, "up").when(pct < 0, "down").otherwise("flat")


def sparkline_points(values: Column) -> Column:
    """x,y pairs of a line through the values, oldest first; empty with fewer than two."""
    n, low = F.size(values), F.array_min(values)
    span = F.when(F.array_max(values) - low == 0, F.lit(1.0)).otherwise(F.array_max(values) - low)
    points = F.transform(values, lambda v, i: F.format_string("%.1f,%.1f", i * (F.lit(float(WIDTH)) / (n - 1)), F.lit(float(HEIGHT - PAD)) - (v - low) / span * float(HEIGHT - 2 * PAD)))
    return F.when(n < 2, "").otherwise(F.array_join(points, " "))


def sparkline(values: Column, moved: Column) -> Column:
    """The line as SVG in the colour of the movement that is shown beside it."""
    color = F.element_at(F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv]), moved)
    head = f'<svg viewBox="0 0 {WIDTH} {HEIGHT}" width="{WIDTH}" height="{HEIGHT}" class="sparkline" aria-hidden="true"><polyline points="'
    tail = '" stroke-width="2" stroke-linecap="round" stroke-linejoin="round"/></svg>'
    points = sparkline_points(values)
    return F.when(points == "", "").otherwise(F.concat(F.lit(head), points, F.lit('" fill="none" stroke="'), color, F.lit(tail)))


def thousands(c: Column, places: int = 2) -> Column:
    return F.format_number(c, places)


def signed_pct(c: Column) -> Column:
    return F.format_string("%+.2f%%", c)


def comma_number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays without repeats; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def retry_after(header: Column, most: int = 30) -> Column:
    """Seconds to wait from a Retry-After header of digits, 1 to most; null if it is none."""
    return clamp(F.floor(header.try_cast("double")).cast("int"), 1, most).cast("int")


def pastel(channel: Column, share: float = 0.85) -> Column:
    """A colour channel blended with white."""
    return F.floor(channel + (255 - channel) * share).cast("int")


def movement_sentence(change: Column, volume: Column) -> Column:
    """What is said of a pick without a reason."""
    parts = F.array_compact(F.array(F.when(change.isNotNull(), F.format_string("최근 등락률 %+.1f%%", change)), F.when(volume.isNotNull(), F.concat(F.lit("거래량 평균 대비 "), volume.cast("string"), F.lit("배")))))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ", "), F.lit(" 흐름을 보이고 있습니다."))).otherwise("관련 데이터를 확인해 주세요.")
