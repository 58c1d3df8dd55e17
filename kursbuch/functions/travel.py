"""Small expressions of a traveller's questions: lenses, dates of a trip, guides, weather and roads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
#: Weekday names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def good_month(letters: Column, month: Column) -> Column:
    """Whether the month (0 = January) is best, good or only rainy."""
    return F.coalesce(F.substr(letters, month.cast("int") + 1, F.lit(1)).isin("B", "G", "R"), F.lit(False))


def fits(mood_bit: Column, moods: Column, letters: Column, month: Column, only_good: Column) -> Column:
    """Whether a place passes the mood (null: any) and the good-this-month lens."""
    mood = mood_bit.isNull() | (F.coalesce(moods, F.lit(0)).bitwiseAND(mood_bit) != 0)
    return mood & (~only_good | good_month(letters, month))


def worthwhile(source: Column, sights: Column) -> Column:
    """Any guide, or one made of landmarks that has three or more. A null source is a guide."""
    return ~source.eqNullSafe(F.lit("wd")) | (sights >= 3)


def station_candidate(halts: Column, in_city: Column, lat: Column, least: int = 8) -> Column:
    return lat.isNotNull() & ((halts >= least) | in_city)


def wants_roads(population: Column, hilly: Column) -> Column:
    """Places whose roads are worth looking up: the famous ones without a population, towns, and small hill towns."""
    return (population == 0) | (population >= 20_000) | (hilly & (population >= 5_000))


def forecast_reaches(day: Column, today: Column) -> Column:
    return F.datediff(day, today).between(0, 15)


def sound_distance(km: Column, straight: Column) -> Column:
    """A distance that a line of this straight length can have; unknown lengths pass."""
    return straight.isNull() | F.isnan(straight.cast("double")) | (km <= 1.45 * straight + 30)


def week_minute(instant: Column, zone: str = "Asia/Kolkata") -> Column:
    """Minutes since Monday midnight, local time, of a UTC instant."""
    t = F.from_utc_timestamp(instant, zone)
    return F.weekday(t) * DAY + F.hour(t) * 60 + F.minute(t)


def day_word(now: Column, wait: Column) -> Column:
    """today, tomorrow, or the weekday: when a wait from this week minute ends."""
    days = F.floor((now % DAY + wait) / DAY).cast("int")
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), ((F.floor(now / DAY).cast("int") + days) % 7 + 1).cast("int"))
    return F.when(days == 0, "today").when(days == 1, "tomorrow").otherwise(name)


def trip_day(first: Column, minutes: Column) -> Column:
    """The date of a minute since midnight of a trip's first day."""
    return F.date_add(first, F.floor(minutes / DAY).cast("int"))


def guide_appeal(listings: Column, photos: Column, banner: Column) -> Column:
    return listings + 3 * photos + F.when(banner, 6).otherwise(0)


def landmark_appeal(links: Column) -> Column:
    """Of the landmarks' fame, as an array: the five most famous, up to 40 each, and how many there are."""
    top = F.slice(F.sort_array(links, asc=False), 1, 5)
    fame = F.aggregate(top, F.lit(0.0), lambda s, x: s + F.least(x, F.lit(40)).cast("double"))
    return F.round(fame / 8 + F.least(F.size(links), F.lit(8)), 1)


def relief(heights: Column) -> Column:
    """Highest minus lowest of the known heights around a place; null with fewer than five."""
    known = F.filter(heights, lambda h: h.isNotNull())
    return F.when(F.size(known) >= 5, F.array_max(known) - F.array_min(known))


def height_corrected(temperature: Column, height: Column, cell_height: Column) -> Column:
    """A cell's temperature at another height, 6.5 degrees a kilometre cooler."""
    return temperature - F.coalesce((height - cell_height) * 0.0065, F.lit(0.0))


def population_doubtful(population: Column, feature: Column) -> Column:
    """District seats that are given their district's population."""
    return (population >= 150_000) & ~feature.isin("PPLA", "PPLC")


def search_lift(halts: Column, is_city: Column) -> Column:
    return 0.3 * F.log10(1 + halts) + F.when(is_city, 0.6).otherwise(0.0)


def place_key(slug: Column) -> Column:
    return F.concat(F.lit("place:"), slug)


def nights_total(nights: Column) -> Column:
    return F.aggregate(nights, F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))
