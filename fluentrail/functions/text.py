"""Text expressions: words, fillers, prolongations, offsets, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The filler words, and the pattern of a stretched first letter in lower case.
# Besides a to z it has the two letters that Unicode counts as case variants of s and i.
FILLERS = ["uh", "um", "ah", "er", "hmm"]
PROLONGATION = r"^([a-z\u017f\u0131])\1{2,}"

# The characters Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Audio and document types by file extension.
CONTENT_TYPES = {
    "flac": "audio/flac",
    "m4a": "audio/mp4",
    "mp3": "audio/mpeg",
    "ogg": "audio/ogg",
    "pdf": "application/pdf",
    "wav": "audio/wav",
}

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def trim_text(text: Column) -> Column:
    """Text without outer white space of any kind, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def split_words(text: Column) -> Column:
    """The white-space separated words of a text; an empty array if there are none."""
    trimmed = trim_text(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def is_filler(word: Column) -> Column:
    """Whether a word is a filler once lower-cased and rid of outer commas and periods."""
    return F.btrim(F.lower(word), F.lit(",.")).isin(FILLERS)


def is_prolongation(word: Column) -> Column:
    """Whether a word starts with the same letter three times or more, in any case."""
    # Few words have the same second and third letter, and comparing two is much quicker than a pattern.
    again = F.lower(F.substring(word, 3, 1)).startswith(F.lower(F.substring(word, 2, 1)))
    return again & F.lower(word).rlike(PROLONGATION)


def offset_seconds(offset: Column) -> Column:
    """``"1.200s"`` as 1.2; null if what is left without the ``s`` is no number.

    A cast to double alone would also take ``1.5d`` and hexadecimal digits. Of digits and
    points it takes numbers only, and most offsets have nothing else. A decimal takes
    neither and is much quicker to try than a pattern with choices, which is left to
    decide on very large numbers and on infinity.
    """
    number = F.replace(offset, F.lit("s"), F.lit(""))
    digits = F.rlike(offset, F.lit(r"^[0-9.s]+\z"))
    plain = number.try_cast("decimal(38,9)").isNotNull()
    return F.when(digits | plain | F.lower(number).rlike(_NUMBER), number.try_cast("double"))


def number_text(number: Column) -> Column:
    """A double as Python prints it: an exponent only below 0.0001 and from 1e16 on."""
    printed = number.cast("string")
    mantissa, power = F.substring_index(printed, "E", 1), F.substring_index(printed, "E", -1).try_cast("int")
    sign = F.when(mantissa.startswith("-"), "-").otherwise("")
    short = F.regexp_replace(mantissa, r"\.0$", "")
    digits = F.regexp_replace(short, r"[-.]", "")
    whole = F.rpad(digits, power + 1, "0")
    places = F.substring(digits, power + 2, F.lit(20))
    return (
        F.when(~F.contains(printed, F.lit("E")), printed)
        .when(power < -4, F.concat(short, F.lit("e-"), F.lpad(F.abs(power).cast("string"), 2, "0")))
        .when(power < 0, F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(power < 16, F.concat(sign, whole, F.lit("."), F.when(places == "", "0").otherwise(places)))
        .otherwise(F.concat(short, F.lit("e+"), power.cast("string")))
    )


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def destination(name: Column, folder: str = "audio") -> Column:
    """Where an uploaded file goes: a name already below ``folder`` stays, any other file moves there."""
    return F.when(name.startswith(f"{folder}/"), name).otherwise(
        F.concat(F.lit(f"{folder}/"), file_name(name))
    )


def content_type(path: Column) -> Column:
    """The media type that a file's extension stands for."""
    extension = F.lower(F.element_at(F.split(file_name(path), r"\."), -1))
    result = F.lit("application/octet-stream")
    for name, kind in CONTENT_TYPES.items():
        result = F.when(extension == name, F.lit(kind)).otherwise(result)
    return result
