"""Places, meeting texts, codes and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A room cell with one of these has no location.
NO_LOCATION = ("미정", "온라인", "비대면", "원격", "e-learning", "etl", "ETL", "none", "None", "nan")
#: Weekdays from Monday.
DAYS = ("월", "화", "수", "목", "금", "토", "일")


def place_campus(place: Column) -> Column:
    """1, 2 or 3: the campus by the mark before a room, '#' or '*'."""
    p = F.trim(F.coalesce(place, F.lit("")))
    return F.when(p.startswith("#"), 2).when(p.startswith("*"), 3).otherwise(1)


def place_building(place: Column) -> Column:
    """Building number of a room, '' where it has none: '083-302' is '83', '220-1-201' is '220-1'."""
    p = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(place, F.lit(""))), "^[#*]", ""), r"\(무선랜제공\)", ""))
    nowhere = p == ""
    for w in NO_LOCATION:
        nowhere = nowhere | p.contains(w)
    parts = F.filter(F.split(p, "-"), lambda x: (x != "") & ~x.rlike("^[A-Za-z]+$"))
    joined = F.when((F.size(parts) == 3) & (F.length(F.get(parts, F.lit(1))) == 1), F.concat(F.get(parts, F.lit(0)), F.lit("-"), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    number = F.ltrim(joined, F.lit("0"))
    return F.when(nowhere | (F.size(parts) == 0), "").otherwise(F.when(number == "", "0").otherwise(number))


MEETING = r"([월화수목금토일])\s*\(\s*(\d{1,2}):(\d{2})\s*~\s*(\d{1,2}):(\d{2})\s*\)"


def parse_meetings(time: Column, rooms: Column) -> Column:
    """array<struct<day, s, e, room, building, campus>> from '월(09:30~10:45)/수(...)' and '301-118/301-118'.

    As many rooms as times pair up; one room serves all; otherwise the first does.
    """
    groups = [F.regexp_extract_all(F.coalesce(time, F.lit("")), F.lit(MEETING), F.lit(i)) for i in range(1, 6)]
    none = F.lower(F.trim(F.coalesce(rooms, F.lit("")))).isin("", "nan", "none")
    room = F.when(none, F.array().cast("array<string>")).otherwise(F.transform(F.split(rooms, "/"), lambda r: F.trim(r)))
    day = F.array(*[F.lit(d) for d in DAYS])

    def one(x: Column, i: Column) -> Column:
        r = F.coalesce(F.when(F.size(room) == F.size(groups[0]), F.get(room, i)).otherwise(F.get(room, F.lit(0))), F.lit(""))
        return F.struct(
            (F.array_position(day, x["0"]) - 1).cast("int").alias("day"), (x["1"].cast("int") * 60 + x["2"].cast("int")).alias("s"), (x["3"].cast("int") * 60 + x["4"].cast("int")).alias("e"),
            r.alias("room"), place_building(r).alias("building"), place_campus(r).alias("campus"),
        )

    return F.transform(F.arrays_zip(*groups), one)


def section_no(value: Column) -> Column:
    """'1.0', '1' and '001' are '001'; longer numbers and other texts stay."""
    s = F.regexp_replace(F.trim(value), r"\.0$", "")
    return F.when(s.rlike(r"^\d{1,2}$"), F.lpad(s, 3, "0")).otherwise(s)


def clean_cell(value: Column, default: str = "") -> Column:
    t = F.trim(value)
    return F.when(value.isNull() | F.lower(t).isin("", "nan", "none", "<na>"), F.lit(default)).otherwise(t)


def hm_to_min(hm: Column) -> Column:
    return F.split_part(hm, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(hm, F.lit(":"), F.lit(2)).cast("int")


def min_to_hm(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def natural_key(building: Column) -> Column:
    """Sorts 9 < 43 < 43-2 < 43-10 < 301 and 919 < 919A < 920; texts that don't start with a digit come last."""
    number = F.regexp_extract(building, r"^(\d+)", 1).try_cast("int") if hasattr(Column, "try_cast") else F.expr("0")
    sub = F.coalesce(F.regexp_extract(building, r"^\d+-(\d+)", 1).try_cast("int"), F.lit(0))
    return F.struct(F.when(number.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(number, F.lit(0)).alias("n"), sub.alias("sub"), building.alias("text"))


def semester_key(label: Column) -> Column:
    """Sortable year * 10 + place of the term in 1 < S < 2 < W; -1 for other labels."""
    ok = label.rlike(r"^\d{4}-[1S2W]$")
    return F.when(ok, F.substring(label, 1, 4).try_cast("int") * 10 + F.instr(F.lit("1S2W"), F.substring(label, 6, 1))).otherwise(-1)


def room_no(room: Column) -> Column:
    return F.substring_index(F.trim(F.regexp_replace(room, r"\([^)]*\)", "")), "-", -1)


def short_name(name: Column) -> Column:
    """A course's name without its closing parenthesis."""
    return F.regexp_replace(name, r"\s*\([^()]*\)\s*$", "")


def clock_seconds(text: Column) -> Column:
    """'SS', 'MM:SS' or 'H:MM:SS' in seconds; null for other texts."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("int"))
    return F.when(text.rlike(r"^\d+(:[0-5]?\d){0,2}$"), F.aggregate(parts, F.lit(0), lambda a, p: a * 60 + p))


def count_label(n: Column) -> Column:
    """A count with its large unit and, below 100 of it, one decimal, rounded down: 12345 is '1.2만'.

    n is of any whole type, decimals without a fraction among them. Its digits are cut, so none is lost to rounding.
    """
    digits = n.cast("string")
    out = digits
    for zeros, name in ((4, "만"), (8, "억"), (12, "조"), (16, "경")):
        head = F.left(digits, F.length(digits) - zeros)
        tenth = F.substr(digits, F.length(head) + 1, F.lit(1))
        text = F.when((F.length(head) <= 2) & (tenth != "0"), F.concat(head, F.lit("."), tenth)).otherwise(head)
        out = F.when(n >= 10**zeros, F.concat(text, F.lit(name))).otherwise(out)
    return out


def floor_number(label: Column) -> Column:
    """'B1', '지하1층', '3F', '3층', '-1': the floor, null for 0 and other texts."""
    t = F.upper(F.regexp_replace(label, r"\s", ""))
    below = F.coalesce(F.nullif(F.regexp_extract(t, r"^(?:B|지하)(\d+)(?:F|층)?$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^-(\d+)(?:F|층)?$", 1), F.lit("")))
    above = F.nullif(F.regexp_extract(t, r"^(?:지상)?(\d+)(?:F|층)?$", 1), F.lit(""))
    return F.nullif(F.coalesce(-below.try_cast("int"), above.try_cast("int")), F.lit(0))


def building_numbers(label: Column) -> Column:
    """Distinct building numbers of a map label, in order: '사범대학10-1동' gives ['10-1']."""
    return F.array_distinct(F.regexp_extract_all(label, F.lit(r"(\d+(?:-\d+)?[A-Z]?)동"), F.lit(1)))


def semester_list(first_year: Column, current: Column, terms: tuple[str, ...] = ("1", "2")) -> Column:
    """array<string>: regular semesters 'year-term' from a year's first up to the current one, in order."""
    years = F.sequence(first_year, F.substring(current, 1, 4).cast("int"))
    every = F.flatten(F.transform(years, lambda y: F.transform(F.array(*map(F.lit, terms)), lambda t: F.concat(y.cast("string"), F.lit("-"), t))))
    return F.filter(every, lambda label: semester_key(label) <= semester_key(current))


def date_range(text: Column) -> Column:
    """struct<opens, closes>: the one or two ISO dates of a text; one date opens and closes; other texts have none."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    opens, closes = F.get(found, F.lit(0)), F.coalesce(F.get(found, F.lit(1)), F.get(found, F.lit(0)))
    return F.struct(opens.try_cast("date").alias("opens"), closes.try_cast("date").alias("closes"))


def year_of(text: Column) -> Column:
    """'3학년' is 3: the digit that a text begins with, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d)", 1), F.lit("")).try_cast("int")


def merged_ranges(ranges: Column) -> Column:
    """array<struct<a, b>> of [a, b): sorted, with those that touch or overlap made one; empty ones go."""
    rows = F.array_sort(F.filter(ranges, lambda r: r["a"] < r["b"]))
    last = lambda done: F.element_at(done, -1)
    joined = lambda done, r: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last(done)["a"].alias("a"), F.greatest(last(done)["b"], r["b"]).alias("b"))))
    return F.when(F.size(rows) == 0, rows).otherwise(F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1)) - 1), F.slice(rows, F.lit(1), F.lit(1)), lambda done, r: F.when(r["a"] <= last(done)["b"], joined(done, r)).otherwise(F.concat(done, F.array(r)))))


def split_marks(text: Column, ranges: Column) -> Column:
    """array<struct<part, marked>>: a text cut at merged ranges; parts without a character go."""
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.length(text).cast("long")), F.transform(ranges, lambda r: r["a"].cast("long")), F.transform(ranges, lambda r: r["b"].cast("long")))))
    parts = F.zip_with(F.slice(cuts, F.lit(1), F.greatest(F.size(cuts), F.lit(1)) - 1), F.slice(cuts, F.lit(2), F.greatest(F.size(cuts), F.lit(1)) - 1), lambda a, b: F.struct(F.substring(text, (a + 1).cast("int"), (b - a).cast("int")).alias("part"), F.exists(ranges, lambda r: (r["a"] <= a) & (b <= r["b"])).alias("marked")))
    return F.filter(parts, lambda p: p["part"] != "")


def parse_pair(text: Column) -> Column:
    """struct<name, a, b> of 'name:a-b' or 'name:a>b' (the arrow where a number has a dash of its own); null for others.

    Without a name it is 'a→b'.
    """
    pair = F.element_at(F.split(text, ":"), -1)
    name = F.when(text.contains(":"), F.substring(text, F.lit(1), F.length(text) - F.length(pair) - 1)).otherwise("")
    sides = F.when(pair.contains(">"), F.split(pair, ">")).when(F.length(pair) - F.length(F.replace(pair, F.lit("-"), F.lit(""))) == 1, F.split(pair, "-"))
    a, b = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    return F.when(F.size(sides) == 2, F.struct(F.when(name == "", F.concat(a, F.lit("→"), b)).otherwise(name).alias("name"), F.trim(a).alias("a"), F.trim(b).alias("b")))


def name_before_colon(name: Column) -> Column:
    """What a course is searched by: its name before a colon, without its closing parenthesis."""
    return F.trim(F.substring_index(short_name(name), ":", 1))


def titled(name: Column, subtitle: Column) -> Column:
    """'name (subtitle)'; blank cells are empty."""
    own, sub = clean_cell(name), clean_cell(subtitle)
    return F.when(sub == "", own).otherwise(F.concat(own, F.lit(" ("), sub, F.lit(")")))


def credits(value: Column) -> Column:
    """A number of credits; 0 for cells that are none."""
    return F.coalesce(clean_cell(value).try_cast("double"), F.lit(0.0))


def rough_count(n: Column) -> Column:
    """A count rounded down to its first digit: 4567 is 4000."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(n, F.lit(1))) + 1e-12))
    return (F.floor(n / unit) * unit).cast("long")


def map_key(label: Column) -> Column:
    """Orders places of a map: numbered buildings by number, then by what follows; other names after them by code point."""
    number = F.regexp_extract(label, r"^(\d+)", 1).try_cast("long")
    return F.struct(number.isNull().alias("kind"), F.coalesce(number, F.lit(0)).alias("n"), F.regexp_replace(label, r"^\d+", "").alias("rest"))


def padded_key(label: Column, width: int = 8) -> Column:
    """A text whose order is natural anywhere in it: every run of digits is padded with zeros."""
    zeros = "0" * width
    padded = F.regexp_replace(label, r"(\d+)", zeros + "$1")
    return F.regexp_replace(padded, rf"0+(?=\d{{{width}}}(?!\d))", "")


def content_id(parts: Column, digits: int = 10) -> Column:
    """A build's id: the first hex digits of a hash of its parts' hashes, in order (array of binary)."""
    return F.substring(F.sha2(F.array_join(F.transform(parts, lambda p: F.sha2(p, 256)), "").cast("binary"), 256), 1, digits)
