"""Running days and times of day as column expressions.

A week clock counts minutes since Monday 00:00; days are a 7-bit mask with bit 0 = Monday, and 0
means unknown, which is treated as daily.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
WEEK = 7 * DAY
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
#: Getting in between 04:30 and 11:30.
MORNING = (270, 690)


def kind_of(train_type: Column) -> Column:
    """toy, local or long."""
    return F.when(train_type == "Toy", "toy").when(train_type.isin("Pass", "MEMU", "DEMU"), "local").otherwise("long")


def day_of(minutes: Column) -> Column:
    return F.floor(minutes / DAY)


def clock(minutes: Column) -> Column:
    return F.pmod(minutes, F.lit(DAY))


def shift_days(mask: Column, days: Column) -> Column:
    """The mask some days on: the weekdays on which a halt that many days into the trip is left."""
    k = F.pmod(days, F.lit(7)).cast("int")
    m = mask.cast("int")
    left = m * F.pow(F.lit(2), k).cast("int")
    right = F.floor(m / F.pow(F.lit(2), (7 - k))).cast("int")
    return left.bitwiseOR(right).bitwiseAND(F.lit(127))


def boards_on(mask: Column, dep: Column) -> Column:
    """Weekdays on which a departure dep minutes into the trip happens; unknown is daily."""
    return F.when(F.coalesce(mask, F.lit(0)) == 0, F.lit(127)).otherwise(shift_days(mask, day_of(dep)))


def has_day(mask: Column, day: int | Column) -> Column:
    bit = F.pow(F.lit(2), F.lit(day) if isinstance(day, int) else day).cast("int")
    return mask.bitwiseAND(bit) != 0


def wait_for(mask: Column, dep: Column, now: int) -> Column:
    """Minutes from week minute ``now`` to the next departure, by running days.

    The departures of a week are the boarding weekdays at dep's clock time; each is a distance
    ahead on the week's circle, and the smallest is the wait."""
    on = boards_on(mask, dep)
    first = F.pmod(clock(dep) - now % DAY, F.lit(DAY))
    ahead = [F.when(has_day(on, d), F.pmod(F.lit(d * DAY) + clock(dep) - now, F.lit(WEEK))) for d in range(7)]
    return F.coalesce(F.when((mask == 0) | (mask == 127), first).otherwise(F.least(*ahead)), first)


def overnight(dep: Column, dur: Column) -> Column:
    """Board in the evening or just after midnight, five to sixteen hours, arrive in the morning."""
    d = clock(dep)
    return ((d >= 1020) | (d < 60)) & dur.between(300, 960) & clock(d + dur).between(*MORNING)


def weekend(mask: Column, dep: Column, dur: Column) -> Column:
    """Friday evening and in by bedtime or on Saturday morning; just after midnight; or Saturday
    morning and at most six hours. The first branch that applies decides."""
    d, on = clock(dep), boards_on(mask, dep)
    at = d + dur
    friday = (at <= 1410) | (at - DAY).between(*MORNING)
    return (
        F.when((d >= 960) & has_day(on, 4), friday)
        .when((d < 60) & has_day(on, 5), at.between(*MORNING))
        .otherwise(d.between(240, 720) & has_day(on, 5) & (dur <= 360))
    )


def days_label(mask: Column) -> Column:
    """Daily; Except the one day off; or the days by name; empty for unknown."""
    names = F.array_join(F.array_compact(F.array(*[F.when(has_day(mask, i), n) for i, n in enumerate(WEEKDAYS)])), ", ")
    off = F.array_join(F.array_compact(F.array(*[F.when(~has_day(mask, i), n) for i, n in enumerate(WEEKDAYS)])), ", ")
    return F.when(mask == 0, "").when(mask == 127, "Daily").when(F.bit_count(mask) == 6, F.concat(F.lit("Except "), off)).otherwise(names)


def format_time(minutes: Column) -> Column:
    """HH:MM, and +N for the days after the first."""
    hm = F.concat_ws(":", F.lpad(F.floor(clock(minutes) / 60).cast("string"), 2, "0"), F.lpad((clock(minutes) % 60).cast("string"), 2, "0"))
    return F.when(minutes >= DAY, F.concat(hm, F.lit("+"), day_of(minutes).cast("string"))).otherwise(hm)


def parse_time(text: Column) -> Column:
    """Minutes of HH:MM or HH:MM+N; null where the text is neither."""
    part = lambda i: F.try_to_number(F.regexp_extract(text, r"^(\d{1,2}):(\d{2})(?:\+(\d+))?$", i), F.lit("999"))
    return part(1).cast("int") * 60 + part(2).cast("int") + F.coalesce(part(3).cast("int"), F.lit(0)) * DAY


def days_mask(text: Column) -> Column:
    """Mon,Thu or Daily to the mask; empty to 0; an unknown word to null."""
    words = F.transform(F.split(text, ","), lambda w: F.trim(w))
    values = F.create_map(*[x for i, n in enumerate(WEEKDAYS) for x in (F.lit(n), F.lit(1 << i))])
    bits = F.transform(words, lambda w: values[w])
    total = F.aggregate(bits, F.lit(0), lambda a, b: a.bitwiseOR(b))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).when(text == "Daily", 127).otherwise(total)


def bucket_of(minutes: Column) -> Column:
    """28 square-root buckets up to 36 hours."""
    return F.least(F.lit(27), F.floor(F.sqrt(F.greatest(F.lit(0), minutes) / 2160.0) * 28)).cast("int")
