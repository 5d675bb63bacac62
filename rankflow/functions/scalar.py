"""Scalar column functions: bins, flags, dates, ratings and text forms. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankflow.functions.names import folded, unescaped


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bins(x: str | Column, edges: list[float], labels: list, right: bool = True, otherwise=None) -> Column:
    """labels[i] for the first edge that x does not exceed (right) or does not reach; the last label, or otherwise,
    beyond. Null stays null."""
    x, out = col(x), None
    for edge, label in zip(edges, labels):
        test = x <= edge if right else x < edge
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    last = labels[len(edges)] if len(labels) > len(edges) else otherwise
    return F.when(x.isNotNull(), out.otherwise(F.lit(last)))


#: Clock, thinking-time, evaluation-swing, loss and phase bins with their right edges.
CLOCK_EDGES, CLOCK_LABELS = [5, 10, 30, 60, 120], ["le5", "le10", "le30", "le60", "le120", "gt120"]
THINK6_EDGES, THINK6_LABELS = [1, 3, 5, 10, 20], ["le1", "le3", "le5", "le10", "le20", "gt20"]
THINK7_EDGES, THINK7_LABELS = [1, 3, 5, 10, 20, 40], ["le1", "le3", "le5", "le10", "le20", "le40", "gt40"]
THINK7_MIDS = [0.5, 2.0, 4.0, 7.5, 15.0, 30.0, 50.0]
SWING_EDGES, SWING_LABELS, SWING_MIDS = [25, 50, 100, 200, 500], ["le25", "le50", "le100", "le200", "le500", "gt500"], [0.125, 0.375, 0.75, 1.5, 3.5, 7.5]
LOSS_EDGES = [10, 25, 50, 100, 200]
PHASES, PHASE_EDGES = ["opening", "early middlegame", "late middlegame", "endgame"], [10, 20, 35]


def clock_bin(x):
    return bins(x, CLOCK_EDGES, CLOCK_LABELS)


def thinking_bin(x):
    return bins(x, THINK6_EDGES, THINK6_LABELS)


def thinking_bin_with_middle(x) -> Column:
    return F.struct(bins(x, THINK7_EDGES, THINK7_LABELS).alias("label"), bins(x, THINK7_EDGES, THINK7_MIDS).alias("middle"))


def swing_bin(x):
    return bins(x, SWING_EDGES, SWING_LABELS)


def loss_token(x):
    return bins(x, LOSS_EDGES, list(range(6)), right=False).cast("long")


def evaluation_token(x, most: int = 1000) -> Column:
    """Clamped to -most..most, in steps of 100: 0 to 2 * most / 100."""
    return F.floor((clip(x, -most, most) + most) / 100)


def move_token(move, step: int = 5, most: int = 20) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor((col(move) - 1) / step)))


def clip(x, low, high) -> Column:
    """Within low..high; null stays null (least and greatest alone would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def phase(move, edges: list[int] | None = None) -> Column:
    return bins(move, edges or PHASE_EDGES, PHASES)


def flag(condition: Column) -> Column:
    """1 where true; 0 where false or null."""
    return F.coalesce(condition.cast("long"), F.lit(0).cast("long"))


def expected_score(own, opponent) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (col(opponent) - col(own)) / 400))


def month_index(date, year: int, month: int, low: int | None = None, high: int | None = None) -> Column:
    """Calendar months since the given one; clamped to low..high if given."""
    index = 12 * (F.year(date) - year) + F.month(date) - month
    return index if low is None else F.least(F.greatest(index, F.lit(low)), F.lit(high))


def whole_months(start, end) -> Column:
    """Completed calendar months from start to end, rounded down."""
    return F.floor(F.months_between(end, start))


def safe_ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def number(x) -> Column:
    """Text as a double; what is none becomes null, and so do NaN and the usual words for missing."""
    value = F.trim(col(x)).try_cast("double")
    return F.when(~F.isnan(value), value)


def whole_number(x) -> Column:
    """Text such as 3 or 3.0 as a long, cut towards zero."""
    return number(x).try_cast("long")


def timestamp(text) -> Column:
    """ISO (space or T) or `MMM d, yyyy, h:mm a` text; narrow no-break spaces count as spaces; else null."""
    clean = F.trim(F.translate(col(text), "  ", "  "))
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy, h:mm a"]
    return F.coalesce(*(F.try_to_timestamp(clean, F.lit(f)) for f in forms))


def dotted_date(text) -> Column:
    """`yyyy.MM.dd`; unknown parts (`?`) make it null."""
    return F.to_date(F.try_to_timestamp(col(text), F.lit("yyyy.MM.dd")))


def clock_seconds(text) -> Column:
    """h:m:s, m:s or s as seconds."""
    return _seconds(_clock_parts(text))


def _clock_parts(text) -> Column:
    return F.reverse(F.split(F.trim(col(text)), ":"))


def _seconds(parts: Column) -> Column:
    part = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return part(0) + F.coalesce(part(1), F.lit(0.0)) * 60 + F.coalesce(part(2), F.lit(0.0)) * 3600


def clocks_seconds(texts: Column) -> Column:
    """clock_seconds of an array; each text is split once."""
    return F.transform(F.transform(texts, _clock_parts), _seconds)


def wrap24(hour) -> Column:
    return F.pmod(col(hour), F.lit(24))


def hour_distance(a, b) -> Column:
    """Distance on the clock, 0 to 12."""
    d = wrap24(col(a) - col(b))
    return F.least(d, 24 - d)


def stars(p) -> Column:
    return bins(p, [0.01, 0.05, 0.1], ["***", "**", "*", ""], right=False)


def swapped_name(text) -> Column:
    """`Last, First` as `First Last`; other names unchanged."""
    return F.when(col(text).contains(","), F.regexp_replace(col(text), r"^\s*([^,]*?)\s*,\s*(.*?)\s*$", "$2 $1")).otherwise(F.trim(col(text)))


def name_forms(text) -> Column:
    """Distinct forms of a name to match by: folded, first and last word, initial and last word, without blanks."""
    name = folded(swapped_name(text))
    words = F.split(name, " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    forms = F.array(name, F.concat_ws(" ", first, last), F.concat_ws(" ", F.substring(first, 1, 1), last), F.concat_ws(" ", last, first), F.replace(name, F.lit(" "), F.lit("")))
    return F.when(name.isNotNull(), F.array_distinct(F.filter(forms, lambda x: x != "")))


#: Words of user names and lists that are no names.
STOP_WORDS = ["gm", "im", "fm", "cm", "wgm", "wim", "wfm", "wcm", "nm", "wnm", "chess", "jr", "sr", "ii", "iii"]


def camel_words(text, stop: list[str] | None = None) -> Column:
    """Words of a user name: capitals, the last capital of several before a small letter, and non-letters begin a new one;
    lower case, of two letters or more, without stop words (STOP_WORDS, unless given)."""
    spaced = F.regexp_replace(F.regexp_replace(col(text), r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.lower(F.trim(F.regexp_replace(spaced, r"[^A-Za-z]+", " "))), " ")
    stops = STOP_WORDS if stop is None else stop
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stops) if stops else F.length(w) >= 2)


def plain_text(html, closed: bool = False) -> Column:
    """HTML without script and style blocks and tags, all character references decoded (closed: only those that a semicolon
    ends), white space as single blanks."""
    out = F.regexp_replace(col(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = unescaped(F.regexp_replace(out, r"(?s)<[^>]+>", " "), closed)
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0B\x1C-\x1F\x85\p{Z}]+", " "))


#: Countries by climate.
SOUTHERN = [
    "Argentina", "Australia", "Bolivia", "Botswana", "Brazil", "Chile", "Fiji", "Indonesia", "Lesotho", "Madagascar", "Malawi", "Mauritius", "Mozambique", "Namibia", "New Zealand", "Paraguay",
    "Peru", "South Africa", "Tanzania", "Uruguay", "Zambia", "Zimbabwe",
]
TROPICAL = [
    "Bangladesh", "Barbados", "Belize", "Cambodia", "Colombia", "Costa Rica", "Cuba", "Dominican Republic", "Ecuador", "El Salvador", "Ghana", "Guam", "Guyana", "Honduras", "Hong Kong", "India",
    "Indonesia", "Jamaica", "Kenya", "Malaysia", "Mexico", "Myanmar", "Nicaragua", "Nigeria", "Panama", "Peru", "Philippines", "Puerto Rico", "Singapore", "Sri Lanka", "Thailand",
    "Trinidad and Tobago", "Vietnam", "Venezuela",
]


def climate(country, month) -> Column:
    """struct<southern, tropical, northern_temperate, winter> (0 or 1) of a country and a month: winter is June to August in
    the south, never in the tropics, else December to February. A country of both lists is southern for its winter."""
    south, tropics = flag(col(country).isin(SOUTHERN)), flag(col(country).isin(TROPICAL))
    winter = F.when(south == 1, flag(month.isin(6, 7, 8))).when(tropics == 1, 0).otherwise(flag(month.isin(12, 1, 2)))
    return F.struct(south.alias("southern"), tropics.alias("tropical"), flag((south == 0) & (tropics == 0)).alias("northern_temperate"), winter.alias("winter"))


def last_segment(url) -> Column:
    """Last part of a URL's path, without query and fragment, percent-decoded."""
    path = F.regexp_replace(F.regexp_replace(col(url), r"[?#].*$", ""), r"/+$", "")
    return F.try_url_decode(F.element_at(F.split(path, "/"), -1))


def game_number(text) -> Column:
    """Digits after `/game/live/` or `/live/game/`, else the first run of eight digits or more, else null."""
    own = F.nullif(F.regexp_extract(col(text), r"(?:/game/live/|/live/game/|/game/)(\d+)", 1), F.lit(""))
    return F.coalesce(own, F.nullif(F.regexp_extract(col(text), r"(\d{8,})", 1), F.lit("")))


def position_key(fen) -> Column:
    return F.substring_index(col(fen), " ", 4)


#: Depth of parentheses that one regular expression takes out; what is nested deeper is counted piece by piece.
NESTED = 64


def _balanced(depth: int) -> str:
    """Pattern of parentheses that are all closed, nested so deep. Every repeat is possessive: nothing is tried twice, and
    Java's matcher recurses by depth only, not by length."""
    inside = r"[^()]*+"
    for _ in range(depth - 1):
        inside = rf"[^()]*+(?:\({inside}\)[^()]*+)*+"
    return rf"\({inside}\)"


def outside_parentheses(text) -> Column:
    """Text without what stands in parentheses, nested to any depth. What follows a parenthesis that is never closed is
    inside it; one that closes nothing is left out alone. Closed ones of up to NESTED levels go by one regular expression;
    only where one that opens is left, the pieces between parentheses are gone through, counting how deep each is."""

    def step(state, piece):
        mark = F.substring(piece, 1, 1)
        depth = F.greatest(F.lit(0), state.depth + F.when(mark == "(", 1).when(mark == ")", -1).otherwise(0))
        own = F.when(mark.isin("(", ")"), F.substring(piece, F.lit(2), F.length(piece))).otherwise(piece)
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat_ws(" ", state.out, own)).otherwise(state.out).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    counted = lambda left: F.aggregate(F.split(left, r"(?=[()])"), start, step, lambda state: state.out)
    rest = lambda left: F.when(F.contains(left, F.lit("(")), counted(left)).otherwise(F.replace(left, F.lit(")"), F.lit(" ")))
    return F.get(F.transform(F.array(F.regexp_replace(col(text), _balanced(NESTED), " ")), rest), F.lit(0))  # named by the lambda: evaluated once


def bare_moves(movetext) -> Column:
    """Movetext as an array of moves: comments, variations nested to any depth, glyphs, numbers and results removed."""
    out = F.regexp_replace(col(movetext), r"\{[^}]*\}", " ")
    out = F.when(F.contains(col(movetext), F.lit(";")), F.regexp_replace(out, r";[^\n]*", " ")).otherwise(out)  # a search for a byte is cheaper
    out = F.regexp_replace(outside_parentheses(out), r"\$\d+|\b(?:1-0|0-1|1/2-1/2)(?!\S)|(?<!\S)\*(?!\S)", " ")
    out = F.regexp_replace(out, r"\d+\.+", " ")
    return F.filter(F.split(out, r"\s+"), lambda x: x != "")

