"""Text clean-up and normalisation as column expressions; Arrow UDFs where Unicode tables are needed."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() has it, as the inside of a class that Java and RE2 both read; BLANK: less the line feed.
BLANK = r"\x{9}\x{B}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE = r"\x{A}" + BLANK
#: The clean-up rules in their order, each on every line of a text; those on edges first.
EDGE = rf"^[{BLANK}，、；。]+|[{BLANK}，、；。]+$"
SPEAKER_DASH = r"^[ \t\x{3000}]*[-\x{2010}-\x{2015}\x{2212}\x{FF0D}][ \t\x{3000}]*"
ELLIPSES = r"(\.{3,}|[…⋯])+"
QUOTE_TAIL = rf"[{BLANK}，、；。]+([」』])"
FULL_WIDTH = r"[ \t\x{3000}]*([，、；。：！？])[ \t\x{3000}]*"
CLEANING = ((EDGE, ""), (SPEAKER_DASH, "-"), (ELLIPSES, "…"), (QUOTE_TAIL, "$1"), (FULL_WIDTH, "$1"))
STRIPPED = "ー〜～・･ 　\t\n!！?？.。,、:：/／「」『』()（）"
SUSPECT = "[A-Za-z]{2,}|[ぁ-ゖァ-ヺー]{2,}"
FOREIGN = "A-Za-zぁ-ゖァ-ヺー"
HAN_OR_KANA = "ぁ-ゖァ-ヺ㐀-䶿一-鿿豈-﫿"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def clean_text(text: Column) -> Column:
    """Of every line: edge punctuation off, one half-width speaker dash, one ellipsis, no punctuation before a closing
    quote, no space round full-width punctuation, and full stops as commas; in this order."""
    for pattern, by in CLEANING:
        text = F.regexp_replace(text, "(?md)" + pattern, by)  # ^ and $ at line feeds only
    return F.replace(text, F.lit("。"), F.lit("，"))


def without_bare_dashes(text: Column) -> Column:
    """Without the lines that are only a speaker dash."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: stripped(line) != "-"), "\n")


def soft_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\N"))


def file_name(title: Column) -> Column:
    """Letters, digits, underscores and hyphens; runs of hyphens and blanks as one underscore."""
    kept = F.regexp_replace(title, rf"[^\p{{L}}\p{{N}}_{WHITE}-]", "")
    return F.regexp_replace(stripped(kept), f"[-{WHITE}]+", "_")


_KANA = {c: c - 0x60 for c in range(0x30A1, 0x30F7)} | {ord(c): None for c in STRIPPED}


def fold(text: str) -> str:
    """For comparing names: compatibility forms, katakana as hiragana, marks and blanks gone, case folded."""
    import unicodedata

    return unicodedata.normalize("NFKC", text).translate(_KANA).casefold()


def folded(text: Column) -> Column:
    """fold() as a column."""

    @F.pandas_udf("string")
    def compatible(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else fold(t))

    return compatible(text)


def without_terms(text: str, terms: list[str]) -> str:
    """The text less the whole occurrences of each term, in turn.

    An occurrence next to another Latin letter or kana is part of a larger word and stays. What a removal brings
    together is looked at again from there on.
    """
    import re

    foreign = re.compile(f"[{FOREIGN}]")
    for term in terms:
        settled, ahead = "", text
        while (at := ahead.find(term)) >= 0:
            settled, ahead = settled + ahead[:at], ahead[at:]
            rest = ahead[len(term) :]
            if foreign.match(settled[-1:]) or foreign.match(rest[:1]):
                settled, ahead = settled + ahead[0], ahead[1:]
            else:
                ahead = rest
        text = settled + ahead
    return text


def is_suspect(text: Column, terms: Iterable[str] = ()) -> Column:
    """A run of two Latin letters or kana is left when whole occurrences of the terms are taken out, the longest terms first."""
    longest_first = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not longest_first:
        return text.rlike(SUSPECT)

    @F.pandas_udf("string")
    def left(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else without_terms(t, longest_first))

    return F.when(text.rlike(SUSPECT), left(text).rlike(SUSPECT)).otherwise(False)


def name_spacer(units: Iterable[str]):
    """A text function that writes the Latin-holding units canonically, one space from Han and kana.

    Blanks inside a unit are tolerated, longer units win; next to a line's edge or punctuation there is no space,
    next to another letter or digit a space stays if there was one. Works line by line: names are looked up in
    the line without its blanks, which are kept aside by the place they stood before.
    """
    import re

    wanted = sorted({u.strip() for u in units if u and re.search("[A-Za-z]", u)}, key=lambda u: (-len(u), u))
    by_letters = {"".join(u.split()): u for u in reversed(wanted)}
    if not by_letters:
        return lambda text: text
    finder = re.compile("|".join(re.escape("".join(u.split())) for u in wanted))
    cjk, cell = re.compile(f"[{HAN_OR_KANA}]"), re.compile(r"([ \t]*)([^ \t]|$)")

    def edge(beside: str, blanks: str) -> str:
        return " " if cjk.match(beside) or blanks and beside.isalnum() else ""

    def spaced(line: str) -> str:
        cells = cell.findall(line)  # each character with the blanks before it; the last has no character
        letters, blanks = "".join(c for _, c in cells), [b for b, _ in cells]
        out, names = [b + c for b, c in cells], list(finder.finditer(letters))
        for before, hit in zip([None, *names], names):
            begin, end = hit.span()
            beside = letters[begin - 1 : begin] if begin else ""
            if before is not None and before.end() == begin and blanks[begin]:
                beside = " "  # the blank went to the name before
            out[begin] = edge(beside, blanks[begin]) + by_letters[hit[0]]
            out[begin + 1 : end] = [""] * (end - begin - 1)
            after = edge(letters[end : end + 1], blanks[end])
            out[begin] += after
            out[end] = letters[end : end + 1]
        return "".join(out)

    return lambda text: "\n".join(map(spaced, text.split("\n")))


def spaced_names(text: Column, units: Iterable[str]) -> Column:
    units = list(units)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        space = name_spacer(units)
        return values.map(lambda t: None if t is None else space(t))

    return run(text)


def source_id(source: Column) -> Column:
    """The id of a source string; null for URLs of unknown sites and for URLs without an id.

    A BV id anywhere wins; v=... stays; YouTube URLs give v= and their v parameter or last path part; the
    other known sites give their last path part; anything that isn't a URL is an id already.
    """
    bv = F.nullif(F.regexp_extract(source, "(BV[a-zA-Z0-9]+)", 1), F.lit(""))
    path = F.regexp_extract(source, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)/*$", 1)
    parameter = F.nullif(F.regexp_extract(source, r"[?&]v=([^&#]+)", 1), F.lit(""))
    youtube = source.contains("youtube.com") | source.contains("youtu.be")
    known = source.contains("bilibili.com") | source.contains("tver.jp") | source.contains("abema.tv")
    return (
        F.when(bv.isNotNull(), bv)
        .when(source.startswith("v="), source)
        .when(youtube, F.concat(F.lit("v="), F.coalesce(parameter, F.nullif(last, F.lit("")))))
        .when(known, last)
        .when(~source.rlike("^https?://"), source)
    )


def platform(key: Column) -> Column:
    return (
        F.when(key.startswith("BV"), "bilibili")
        .when(key.startswith("v="), "youtube")
        .when(key.rlike("^(ep|sh)[A-Za-z0-9]*$"), "tver")
        .when(key.isNotNull(), "abema")
    )


def source_url(key: Column) -> Column:
    site = platform(key)
    return (
        F.when(site == "bilibili", F.concat(F.lit("https://www.bilibili.com/video/"), key))
        .when(site == "tver", F.concat(F.lit("https://tver.jp/episodes/"), key))
        .when(site == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(key, 3, 1 << 30)))
        .when(site == "abema", F.concat(F.lit("https://abema.tv/video/episode/"), key))
    )


def json_object(text: Column) -> Column:
    """From the first brace to the last, without code fences; text without braces as it is, stripped."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(inner, stripped(text))
