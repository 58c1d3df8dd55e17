"""Small columns that name, parse and format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a train's name, the first that occurs decides.
TYPE_WORDS = [
    ("JAN SHATABDI", "JShtb"), ("RAJDHANI", "Raj"), ("SHATABDI", "Shtb"), ("DURONTO", "Drnt"), ("GARIB", "GR"),
    ("SAMPARK", "SKr"), ("MEMU", "MEMU"), ("DEMU", "DEMU"), ("DMU", "DEMU"), ("PASS", "Pass"),
]
#: Then the first digits of its number.
TYPE_DIGITS = {"0": "Spl", "5": "Pass", "6": "MEMU", "7": "DEMU"}
FAST_NUMBERS = ("12", "20", "22")


def infer_type(number: Column, name: Column) -> Column:
    n = F.upper(name)
    out = F.when(F.contains(n, F.lit(TYPE_WORDS[0][0])), TYPE_WORDS[0][1])
    for word, kind in TYPE_WORDS[1:]:
        out = out.when(F.contains(n, F.lit(word)), kind)
    for digit, kind in TYPE_DIGITS.items():
        out = out.when(F.startswith(number, F.lit(digit)), kind)
    return out.when(F.substring(number, 1, 2).isin(*FAST_NUMBERS), "SF").otherwise("Exp")


def is_suburban(number: Column, name: Column) -> Column:
    return F.substring(number, 1, 1).isin("3", "4", "9") | F.upper(name).rlike(r"(^|[^MD])EMU\b|\bLOC(AL)?\b|MMTS")


def weather(code: Column) -> Column:
    """WMO weather codes in words."""
    return (
        F.when(code == 0, "Clear").when(code == 1, "Mostly clear").when(code == 2, "Partly cloudy").when(code == 3, "Overcast")
        .when(code.isin(45, 48), "Fog").when(code.between(51, 57), "Drizzle").when(code.between(65, 67), "Heavy rain").when(code.between(61, 64), "Rain")
        .when(code.between(71, 77), "Snow").when(code.between(80, 82), "Showers").when(code.between(85, 86), "Snow showers")
        .when(code >= 95, "Thunderstorms").otherwise("Cloudy")
    )


def minutes_text(m: Column) -> Column:
    """45m, 2h, 8h 40m, of whole minutes."""
    h, rest = F.floor(m / 60).cast("string"), m % 60
    return F.when(m < 60, F.concat(m.cast("string"), F.lit("m"))).when(rest == 0, F.concat(h, F.lit("h"))).otherwise(F.concat(h, F.lit("h "), rest.cast("string"), F.lit("m")))


def indian_number(n: Column) -> Column:
    """Digits grouped as in India: the last three, then by two."""
    s = n.cast("string")
    head = F.regexp_replace(F.substr(s, F.lit(1), F.length(s) - 3), r"(\d)(?=(\d\d)+$)", "$1,")
    return F.when(F.length(s) <= 3, s).otherwise(F.concat(head, F.lit(","), F.right(s, F.lit(3))))


def parse_roads(text: Column) -> Column:
    """'CODE km mins;@IATA km mins' to a map; null (unknown) stays null, '' (no road) is an empty map."""
    parts = F.filter(F.split(text, ";"), lambda p: F.size(F.split(p, " ")) >= 3)
    entry = lambda p: F.struct(F.split(p, " ")[0], F.struct(F.split(p, " ")[1].cast("int").alias("km"), F.split(p, " ")[2].cast("int").alias("mins")))
    return F.map_from_entries(F.transform(parts, entry))


def told_in(fact: Column, body: Column) -> Column:
    """Whether every number of two figures or more in the fact stands in the body, and there is one."""
    numbers = F.filter(F.regexp_extract_all(fact, F.lit(r"\d[\d,.]*\d|\d"), F.lit(0)), lambda n: F.length(n) > 1)
    return (F.size(numbers) > 0) & F.forall(numbers, lambda n: F.contains(body, n))


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""), r"\s+", " "))


def thumbnail(name: Column, width: int = 330) -> Column:
    """The address of a shared photo's thumbnail: folders by the MD5 of its name, kinds by its ending."""
    fn = F.replace(name, F.lit(" "), F.lit("_"))
    quoted = F.replace(F.replace(F.url_encode(fn), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    h, ending = F.md5(fn), F.lower(F.element_at(F.split(fn, r"\."), -1))
    plain = F.concat(F.lit(f"{width}px-"), quoted)
    thumb = (
        F.when(ending.isin("tif", "tiff"), F.concat(F.lit("lossy-page1-"), plain, F.lit(".jpg")))
        .when(ending == "svg", F.concat(plain, F.lit(".png")))
        .otherwise(plain)
    )
    return F.concat_ws("/", F.lit("https://upload.wikimedia.org/wikipedia/commons/thumb"), F.substring(h, 1, 1), F.substring(h, 1, 2), quoted, thumb)


def same_ends(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Unordered pairs are equal; null where an end is unknown."""
    return (F.least(a1, b1) == F.least(a2, b2)) & (F.greatest(a1, b1) == F.greatest(a2, b2)) & a1.isNotNull() & b1.isNotNull()


#: The widths that thumbnails are kept in.
STEPS = (120, 250, 330, 500, 960, 1280, 1920)


def photo_width(width: Column, want: Column) -> Column:
    """The step to ask for: the first that is wide enough, or the widest; never above the photo's own width,
    else the widest step below that. 0 where no step is: the photo itself. A null or zero width is unknown."""
    steps = F.array(*map(F.lit, STEPS))
    step = F.coalesce(F.array_min(F.filter(steps, lambda s: s >= want)), F.lit(STEPS[-1]))
    below = F.coalesce(F.array_max(F.filter(steps, lambda s: s < width)), F.lit(0))
    return F.when(F.coalesce(width, F.lit(0)) == 0, step).when(step < width, step).otherwise(below)


def photo_url(thumb: Column, width: Column, want: Column) -> Column:
    """The thumbnail's address at that width; addresses without a width stay."""
    step = photo_width(width, want)
    sized = F.concat(F.regexp_extract(thumb, r"^(.*/)\d+px-[^/]+$", 1), step.cast("string"), F.regexp_extract(thumb, r"/\d+(px-[^/]+)$", 1))
    return F.when(thumb.rlike(r"/\d+px-[^/]+$") & (step > 0), sized).otherwise(thumb)


def credit(by: Column, licence: Column, file: Column) -> Column:
    """Who made a photo, and its licence; where neither is known, the file's name and where it lies."""
    by, licence = F.coalesce(by, F.lit("")), F.coalesce(licence, F.lit(""))
    named = F.when((by != "") & ~by.rlike("(?i)^unknown"), by).otherwise("Unknown author")
    title = F.regexp_replace(F.replace(F.coalesce(file, F.lit("photo")), F.lit("_"), F.lit(" ")), r"\.\w+$", "")
    plain = F.concat(title, F.lit(" \u00b7 Wikimedia Commons"))
    return F.when((by == "") & (licence == ""), plain).otherwise(F.concat(named, F.when(licence != "", F.concat(F.lit(", "), licence)).otherwise("")))


def believable_speed(km: Column) -> Column:
    """The fastest average between two halts, in km/h. Fixed values."""
    return F.when(km >= 300, 105).when(km >= 40, 135).otherwise(160)
