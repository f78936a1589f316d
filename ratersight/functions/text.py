"""Scalar functions on ratings' bodies, transcripts, labels and times, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns that find a rating or an explanation where a body is not JSON.
RATING = r'(?i)"rating":\s*(\d+(\.\d+)?)'
EXPLANATION = r"(?i)explanation:\s*([^\n]+)"


def _found(body: Column, pattern: str) -> Column:
    got = F.regexp_extract(body, pattern, 1)
    return F.when(got != "", got)


def is_json(body: Column) -> Column:
    """Whether a body parses as a JSON object."""
    return F.coalesce(F.get_json_object(body, "$").isNotNull(), F.lit(False)) & F.trim(body).startswith("{")


def rating(body: Column) -> Column:
    """The rating as a double: the JSON field if the body parses (other types than numbers and their texts are missing),
    else the pattern's number without its fraction."""
    return F.when(is_json(body), F.get_json_object(body, "$.rating").try_cast("double")).otherwise(F.floor(_found(body, RATING).try_cast("double")).cast("double"))


def explanation(body: Column) -> Column:
    return F.when(is_json(body), F.get_json_object(body, "$.explanation")).otherwise(_found(body, EXPLANATION))


def last_rating(text: Column) -> Column:
    """The integer after the last `Rating:`; null if there is none or it is no integer."""
    return F.when(text.contains("Rating:"), F.trim(F.element_at(F.split(text, "Rating:"), -1)).try_cast("int"))


def last_digits(text: Column) -> Column:
    """The digits of the first line after the last `rating:`."""
    line = F.split(F.trim(F.element_at(F.split(text, "rating:"), -1)), "\n")[0]
    return F.when(text.contains("rating:"), F.regexp_replace(line, "[^0-9]", "").try_cast("int"))


def count_of(text: Column, part: str) -> Column:
    """Times that part occurs in text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def tokens(text: Column) -> Column:
    """Words between white space; stands in for a model's tokenizer."""
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def keep_last(text: Column, n: int) -> Column:
    """The last n tokens, joined by spaces."""
    own = tokens(text)
    return F.array_join(F.slice(own, F.greatest(F.size(own) - n + 1, F.lit(1)), n), " ")


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS.mmm, cut at milliseconds."""
    ms = F.floor(seconds * 1000 + 1e-6).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def short_name(name: Column, longest: int = 28, kept: int = 25) -> Column:
    """A label up to its bracket, cut and dotted if it is still too long."""
    own = F.trim(F.split(name, r"\(")[0])
    return F.when(F.length(own) > longest, F.concat(F.substring(own, 1, kept), F.lit("..."))).otherwise(own)


def context(n: Column) -> Column:
    """A context length in thousands or millions, cut."""
    return F.when(n >= 1_000_000, F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(n / 1000).cast("string"), F.lit("k")))


def size_label(total: Column, active: Column) -> Column:
    """`total(active)`, or total alone where both are equal."""
    return F.when(total == active, total).otherwise(F.concat(total, F.lit("("), active, F.lit(")")))


def architecture(x: Column) -> Column:
    """MoE or Dense in one spelling, --- for all else and for null."""
    return F.when(F.upper(x) == "MOE", "MoE").when(F.upper(x) == "DENSE", "Dense").otherwise("---")


def sheet_name(item: Column, name: Column) -> Column:
    own = F.concat(F.lpad(item.cast("string"), 2, "0"), F.lit(" - "), name)
    return F.when(F.length(own) > 31, F.concat(F.substring(own, 1, 28), F.lit("..."))).otherwise(own)


def prompt(instructions: Column, transcript: Column, user_only: bool = False) -> Column:
    """The messages of one request: instructions for the system, transcript and cue for the user; or all for the user, for
    models that take no system message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = F.concat(transcript, F.lit("\n\nOutput:\nRating:"))
    if user_only:
        return F.array(message("user", F.concat(instructions, F.lit("\n\n"), asked)))
    return F.array(message("system", instructions), message("user", asked))


def keep_room(instructions: Column, transcript: Column, most: int) -> Column:
    """The transcript's last tokens, as many as the instructions leave of `most`; none where they leave none."""
    own = tokens(transcript)
    room = F.greatest(F.lit(most) - F.size(tokens(instructions)), F.lit(0))
    return F.when(room > 0, F.array_join(F.slice(own, F.greatest(F.size(own) - room + 1, F.lit(1)), F.greatest(room, F.lit(1))), " ")).otherwise("")


def shown_variant(variant: Column) -> Column:
    """A variant's name for people: underscores as spaces, words with a capital."""
    return F.initcap(F.replace(variant, F.lit("_"), F.lit(" ")))


#: Families of models, by the first of these substrings that a name holds.
FAMILIES = (("Qwen", "Qwen"), ("QwQ", "Qwen"), ("Llama", "Llama"), ("DeepSeek", "DeepSeek"), ("Gemma", "Gemma"), ("GPT", "GPT"), ("Magistral", "Magistral"))


def family(name: Column) -> Column:
    """The family of a model's name, `Other` for no match."""
    out = F.lit("Other")
    for part, own in reversed(FAMILIES):
        out = F.when(name.contains(part), own).otherwise(out)
    return out


def log_params(size: Column) -> Column:
    """log10 of a number of parameters such as `3.6B`; null where it is none."""
    n = F.replace(size, F.lit("B"), F.lit("")).try_cast("double") * 1e9
    return F.when(n > 0, F.log10(n))


def steps_of_10ms(seconds: Column) -> Column:
    """Seconds in whole steps of 10 ms, cut."""
    return (seconds / 0.01).cast("long")


def epoch_text(seconds: Column) -> Column:
    """Seconds since 1970 as a time in the session's zone, years past 9999 without a sign; an empty text for null."""
    return F.coalesce(F.ltrim(F.from_unixtime(seconds, "yyyy-MM-dd HH:mm:ss"), F.lit("+")), F.lit(""))


def roles(line: Column) -> Column:
    """(role, text) of an utterance that a model has labelled `Role: text`; Unclear where it names no known role."""
    pattern = r"^\s*(Practitioner|Patient|Unclear)\s*:\s*(.*)$"
    role = F.regexp_extract(line, pattern, 1)
    return F.struct(F.when(role != "", role).otherwise("Unclear").alias("role"), F.when(role != "", F.regexp_extract(line, pattern, 2)).otherwise(F.trim(line)).alias("text"))


def tint(x: Column, low, high) -> Column:
    """Three bands: 0 below low, 1 between, 2 from high on; null for null."""
    return F.when(x.isNull(), None).when(x < low, 0).when(x >= high, 2).otherwise(1)


#: Bounds of the place between best and worst, and the shades up to them; beyond the last there is none.
SHADES = ((0.05, 40), (0.10, 32), (0.20, 25), (0.35, 18), (0.50, 12), (0.70, 8), (0.85, 5))


def heat(x: Column, least: Column, most: Column, low_is_best: bool = True) -> Column:
    """The shade, 0 to 40, of a value's place between the best and the worst one; 0 where they are equal or it is unknown."""
    place = F.try_divide(x - least, most - least)
    place = place if low_is_best else 1 - place
    out = F.lit(0)
    for bound, shade in reversed(SHADES):
        out = F.when(place < bound, shade).otherwise(out)
    return F.when(place.isNull(), 0).otherwise(out).cast("int")


def cell_colour(x: Column, least: Column, most: Column, low_is_best: bool = True, slack: float = 1e-6) -> Column:
    """`blue!n` towards the best value, `red!n` towards the worst one, an empty text between; both extremes are 40, ties
    within slack included. The red side has the first four shades alone, by the distance from the worst value."""
    best, worst = (least, most) if low_is_best else (most, least)
    place = F.coalesce(F.try_divide(x - least, most - least), F.lit(0.5))
    place = place if low_is_best else 1 - place
    red = F.lit(0)
    for bound, shade in reversed(SHADES[:4]):
        red = F.when(1 - place < bound, shade).otherwise(red)
    blue = heat(x, least, most, low_is_best)
    low_tie, high_tie = F.abs(x - least) <= slack, F.abs(x - most) <= slack
    low_name, high_name = ("blue!40", "red!40") if low_is_best else ("red!40", "blue!40")
    shaded = F.when(place < 0.5, F.when(blue > 0, F.concat(F.lit("blue!"), blue.cast("string"))).otherwise("")).otherwise(F.when(red > 0, F.concat(F.lit("red!"), red.cast("string"))).otherwise(""))
    return F.when(x.isNull() | best.isNull() | worst.isNull(), "").when(low_tie, low_name).when(high_tie, high_name).otherwise(shaded)
