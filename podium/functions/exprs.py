"""Column functions: names of divisions and events, labels, marks and lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.schema import B_GROUP, RECORD_MARKS, TEAM_EVENTS, any_of

#: All characters up to U+0020: what trimming removes.
_SPACES = "".join(map(chr, range(0x21)))


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACES))


def blank_to_null(x: Column) -> Column:
    return F.nullif(trimmed(x), F.lit(""))


def is_blank(x: Column) -> Column:
    """Null, empty, or white space only."""
    return F.coalesce(~x.rlike(r"[^\s  - 　]"), F.lit(True))


def lenient_int(x: Column) -> Column:
    return trimmed(x.cast("string")).try_cast("int")


def first_of(text: Column, pairs: list[tuple[str, Column | str | int]], otherwise=None) -> Column:
    """The value of the first word that the text contains."""
    out = None
    for word, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(text.contains(word), value) if out is None else out.when(text.contains(word), value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


# Short and long names of school levels.
_LEVELS = (("초부", "초등부"), ("중부", "중등부"), ("고부", "고등부"), ("대부", "대학부"), ("일부", "일반부"))


def report_division(division: Column) -> Column:
    """Division as reports name it: without the gender in front, levels in full."""
    out = F.regexp_replace(division, "^(여자?|남자?)", "")
    for short, full in _LEVELS:
        out = F.regexp_replace(out, f"^{short}", full)
    return out


def division_category(division: Column) -> Column:
    """School level for matching athletes; null is empty."""
    found = first_of(division, [("초", "초등"), ("중", "중등"), ("고", "고등")], "대일")
    return F.when(division.isNull(), F.lit("")).otherwise(found)


def record_rank(mark: Column) -> Column:
    out = F.lit(9)
    for k, name in reversed(list(enumerate(RECORD_MARKS))):
        out = F.when(mark == name, k).otherwise(out)
    return out


def division_rank(division: Column) -> Column:
    """Sort order of a report division; B groups stand apart within the youngest level."""
    grades = lambda base: first_of(division, [("1,2학년", base), ("3,4학년", base + 1), ("5,6학년", base + 2)], base + 3)
    out = F.lit(99)
    for name, rank in (("일반부", 50), ("대학부", 40), ("고등부", 30), ("중등부", 20)):
        out = F.when(division.startswith(name), rank).otherwise(out)
    return F.when(division.contains(B_GROUP), grades(14)).when(division.startswith("초등부"), grades(10)).otherwise(out)


def gender_rank(division: Column) -> Column:
    return F.when(division.startswith("여"), 0).when(division.startswith("남"), 1).otherwise(2)


def distance(event_name: Column) -> Column:
    """Metres of an event by its name; 99999 if it names none."""
    digits = F.replace(F.regexp_extract(event_name, r"(\d[\d,]*)m", 1), F.lit(","))
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(99999))


def competition_label(edition: Column, short_name: Column, name: Column) -> Column:
    return F.concat(F.when(edition.isNotNull(), F.concat(F.lit("제"), edition.cast("string"), F.lit("회 "))).otherwise(""), F.coalesce(short_name, name))


def day_label(day: Column, date: Column) -> Column:
    """``제1일차 (3/20 금)``, or without a date ``제1일차``."""
    names = F.array(*[F.lit(x) for x in "월화수목금토일"])
    when = F.concat(F.lit(" ("), F.month(date).cast("string"), F.lit("/"), F.dayofmonth(date).cast("string"), F.lit(" "), F.element_at(names, F.weekday(date) + 1), F.lit(")"))
    return F.concat(F.lit("제"), day.cast("string"), F.lit("일차"), F.coalesce(when, F.lit("")))


def infer_gender(division: Column) -> Column:
    return F.when(division.startswith("여") | division.contains("여자"), "F").otherwise("M")


def _last_digit(code: Column) -> Column:
    return F.coalesce(F.right(code, F.lit(1)).try_cast("int"), F.lit(0))


def heat_from_code(code: Column, round_name: Column) -> Column:
    """Heat number from a national code: finals (309...) are 0, else the heat in the round's name or the last digit."""
    named = F.nullif(F.regexp_extract(round_name, r"(\d+)조", 1), F.lit("")).try_cast("int")
    return F.when(code.isNull() | code.startswith("309") | (F.length(code) < 6), 0).otherwise(F.coalesce(named, _last_digit(code)))


def heat_from_youth_code(code: Column) -> Column:
    return F.when(code.isNull() | (code == "") | code.contains("9000") | code.contains("9090"), 0).otherwise(_last_digit(code))


def record_mark(text: Column) -> Column:
    """The strongest new-record mark in a text, or null."""
    return first_of(text, [(m, m) for m in RECORD_MARKS])


def record_mark_two(text: Column) -> Column:
    """As lists of results have it: national, then meet."""
    return first_of(text, [("한국신", "한국신"), ("대회신", "대회신")])


def rank_note(code: Column) -> Column:
    """What a rank column says instead of a number, or null for a number."""
    other = F.when(code == "EL", "제외").when(code.isin("DF", "DQ", "DSQ"), "실격").when(code == "DNF", "미완주").when(code == "DNS", "미출전").otherwise(code)
    return F.when(code.try_cast("int").isNull(), other)


def with_rank_note(note: Column, code: Column) -> Column:
    return F.nullif(F.concat_ws(" ", note, rank_note(code)), F.lit(""))


def division_variants(division: Column) -> Column:
    """Ordered array of the names under which a division may be stored."""
    short = division
    for full, brief in (("자초등부", "초"), ("자중학부", "중"), ("자고등부", "고"), ("자일반부", "일"), ("자대학부", "대")):
        short = F.replace(short, F.lit(full), F.lit(brief))
    sex = F.when(division.startswith("여"), "여").otherwise("남")
    ages = lambda level, *names: F.when(division.contains(level), F.array(*[F.concat(sex, F.lit(n)) for n in names])).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(division), F.when(short != division, F.array(short)).otherwise(F.array().cast("array<string>")), ages("초", "자12세이하부", "자13세이하부"), ages("중", "자15세이하부", "자16세이하부", "16이하"), ages("고", "자18세이하부", "자19세이하부"))


def round_base(round_name: Column) -> Column:
    """Round without the heat or match number at its end."""
    return trimmed(F.regexp_replace(F.regexp_replace(round_name, "[0-9]+조$", ""), r"경기\d+$", ""))


def round_variants(round_name: Column) -> Column:
    base = round_base(round_name)
    return F.when((base != round_name) & (base != ""), F.array(round_name, base)).otherwise(F.array(round_name))


def plain_event(event_name: Column) -> Column:
    return F.replace(event_name, F.lit(","))


def _after(text: Column, word: Column) -> Column:
    """What follows a word and a space."""
    return F.substr(text, F.length(word) + 2)


def _without(text: Column, word: Column) -> Column:
    return F.when(F.startswith(text, F.concat(word, F.lit(" "))), _after(text, word)).otherwise(text)


def _affiliated(region: Column, rest: Column, digits: Column) -> dict[str, Column]:
    return {"region": trimmed(region), "team": trimmed(F.left(rest, F.length(rest) - F.length(digits))), "grade": F.nullif(digits, F.lit("")).try_cast("int")}


def affiliation(info: Column) -> Column:
    """struct<region, team, grade> of ``region [region] team[grade]``."""
    text = trimmed(info)
    region = F.substring_index(text, " ", 1)
    rest = _without(_after(text, region), region)
    return F.struct(*[x.alias(k) for k, x in _affiliated(region, rest, F.regexp_extract(rest, r"(\d+)$", 1)).items()])


def with_affiliation(df: DataFrame, info: Column, prefix: str) -> DataFrame:
    """``affiliation`` as columns, step by step: each is worked out once a row, where the one expression repeats what it is made of."""
    text, region, rest, digits = (f"{prefix}{k}" for k in ("_text", "_word", "_rest", "_digits"))
    df = df.withColumn(text, trimmed(info)).withColumn(region, F.substring_index(text, " ", 1)).withColumn(rest, _after(F.col(text), F.col(region)))
    df = df.withColumn(rest, _without(F.col(rest), F.col(region))).withColumn(digits, F.regexp_extract(rest, r"(\d+)$", 1))
    return df.withColumns({f"{prefix}{k}": x for k, x in _affiliated(F.col(region), F.col(rest), F.col(digits)).items()}).drop(text, region, rest, digits)


def affiliation_note(info: Column) -> Column:
    """Affiliation without the grade at its end."""
    text = trimmed(info)
    short = F.regexp_extract(text, r"^(.+?)\d*$", 1)
    return F.when(short != "", trimmed(short)).otherwise(text)


def is_team_event(name: Column) -> Column:
    return any_of([name.contains(w) for w in TEAM_EVENTS])


def is_team_listing(name: Column) -> Column:
    """Relays as result lists name them."""
    return any_of([name.contains(w) for w in ("계주", "릴레이", "Relay")])


def record_ms(record: Column) -> Column:
    """Milliseconds of ``m:ss.mmm`` or ``ss.mmm``; null for scores and other text."""
    minutes = F.coalesce(F.nullif(F.regexp_extract(record, r"^(\d+):", 1), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    seconds = F.regexp_extract(record, r"^(?:\d+:)?(\d+)\.(\d{1,3})\d*$", 1).try_cast("long")
    fraction = F.rpad(F.regexp_extract(record, r"^(?:\d+:)?(\d+)\.(\d{1,3})\d*$", 2), 3, "0").try_cast("long")
    return minutes * 60_000 + seconds * 1000 + fraction


def medal_score(ranking: Column) -> Column:
    """Points of ranks 1 to 6; others have none."""
    points = F.lit(0)
    for rank, score in ((6, 1), (5, 2), (4, 3), (3, 4), (2, 5), (1, 7)):
        points = F.when(ranking == rank, score).otherwise(points)
    return points


def count_medals(ranking: Column) -> list[Column]:
    """gold, silver, bronze and total as aggregates."""
    one = [F.count_if(ranking == k).alias(name) for k, name in ((1, "gold"), (2, "silver"), (3, "bronze"))]
    return [*one, F.count_if(ranking.isin(1, 2, 3)).alias("total")]
