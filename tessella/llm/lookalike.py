"""One spelling for texts that look the same.

A token's letters each carry the set of scripts they are used in.  Where these
sets have no script in common the token mixes scripts; where they have one but
every letter also has a twin in another script the token as a whole can be
read in both.  Either way the spelling in the script the text is written in is
selected.  Latin letters of phonetic and small-capital use that look like plain
ones give way in words that are otherwise plain, and look-alikes of 0 and 1
inside a number become digits.  What remains (wide and joined forms, composable accents, unusual
blanks, invisible characters) is replaced form by form.  Signs with a look of
their own - superscripts, fractions, circled and Greek quantities - stay.

Defined results: null gives null, the empty text the empty text; texts in ASCII
are returned as they are without leaving the JVM; length does not matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that look like a Latin letter.
TWINS = dict(
    zip(
        "аеорсухіјѕԁһԛԝѵӏԍАВЕКМНОРСТХУІЈЅԌԚԜҮ",
        "aeopcyxijsdhqwvlgABEKMHOPCTXYIJSGQWY",
        strict=True,
    )
) | dict(
    zip(
        "οναιρυγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ",
        "ovaipuyABEZHIKMNOPTYXCj",
        strict=True,
    )
) | dict(zip("օսոհցՕՍ", "ounhgOU", strict=True)) | dict(
    zip(
        "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ",
        "ABCDEGHJKLMPRSTVWZ",
        strict=True,
    )
) | dict(
    zip(
        "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ",
        "ABCDEFGHIJKLMNOPRSTUVWXYZ",
        strict=True,
    )
) | dict(zip("ⲟⲣⲥⲞⲢⲤⲘⲚⲦⲔ", "opcOPCMNTK", strict=True))
# Latin letters that look like a plain one.
LATIN_TWINS = dict(zip("ɡɑıᴄᴏᴠᴡᴢꜱᴜⅼ", "gaicovwzsul", strict=True))
# Letters by which a text shows that it writes the dotless i.
DOTLESS = regex.compile(r"[ğşĞŞİ]")
# Plain letters that look like a digit.
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}
# Of these the shape alone does not tell; only a mixed token gives them away.
WEAK = frozenset("αιρυγνВНвнг")

# Format characters that shape text in some scripts, and where they do.
JOINERS = "\u200c\u200d"
JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Gujarati}\p{Gurmukhi}\p{Oriya}\p{Emoji_Presentation}\u2640\u2642\u2695\u2764\ufe0f]")
INVISIBLE = regex.compile(r"[\p{Cf}\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0]")
KEPT_FORMAT = regex.compile(r"[\u0600-\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd\U000e0020-\U000e007f]")
BLANK = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}]")
TOKEN = regex.compile(r"[\p{L}\p{M}\u217c]+")
HAS_OTHER = regex.compile(r"[^\x00-\x7f]")
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Lisu", "Coptic")
SCRIPT_TESTS = {s: regex.compile(rf"\p{{Script_Extensions={s}}}") for s in SCRIPTS}
#: Decompositions whose result looks the same as the character itself.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")


@lru_cache(maxsize=65536)
def scripts_of(ch: str) -> frozenset[str]:
    """Scripts a letter is used in; empty for marks and anything inherited."""
    if ord(ch) < 128:
        return frozenset(("Latin",))
    if unicodedata.category(ch)[0] == "M":
        return frozenset()
    return frozenset(s for s, t in SCRIPT_TESTS.items() if t.match(ch)) or frozenset(("Other",))


@lru_cache(maxsize=65536)
def plain_form(ch: str) -> str:
    """The plain characters that look like ``ch``, else ``ch``."""
    if ord(ch) < 128:
        return ch
    if BLANK.match(ch):
        return " "
    kind, _, codes = unicodedata.decomposition(ch).partition(" ")
    if kind in SAME_LOOK:
        return unicodedata.normalize("NFKC", ch)
    if kind == "<compat>":
        full = unicodedata.normalize("NFKC", ch)
        if len(full) > 1 and all(unicodedata.category(c)[0] == "L" for c in full) and unicodedata.category(ch)[0] in "LN":
            return full
    return ch


def _resolved(token: str, home: str, near: set[str]) -> str:
    """A token in one script.

    ``home`` is the script its text is written in, ``near`` are the scripts of
    which the tokens beside it leave no doubt.
    """
    shared = None
    for ch in token:
        own = scripts_of(ch)
        if own:
            shared = own if shared is None else shared & own
    if shared is None or "Latin" in shared:
        return token
    foreign = [ch for ch in token if scripts_of(ch) and "Latin" not in scripts_of(ch)]
    twins = [ch for ch in foreign if ch in TWINS]
    if not twins:
        return token
    if len(twins) == len(foreign):
        if len(foreign) < len([ch for ch in token if scripts_of(ch)]):
            return "".join(TWINS.get(ch, ch) for ch in token)  # mixed
        if home == "Latin" and not near & {s for ch in foreign for s in scripts_of(ch)} and not all(ch in WEAK for ch in foreign):
            return "".join(TWINS.get(ch, ch) for ch in token)  # as a whole
        return token
    own = {s for ch in foreign if ch not in TWINS for s in scripts_of(ch)}
    back = {}
    for other, latin in TWINS.items():
        if scripts_of(other) & own:
            back.setdefault(latin, other)
    latin = [ch for ch in token if "Latin" in scripts_of(ch)]
    if latin and len(own) == 1 and len(foreign) > len(latin) and all(ch in back for ch in latin):
        return "".join(back.get(ch, ch) for ch in token)  # Latin letters inside a word of another script
    return token


def _is_plain(ch: str) -> bool:
    """An ASCII letter, with accents or without."""
    return ch.isascii() or unicodedata.normalize("NFD", ch)[0].isascii()


def _plain_latin(token: str, dotless: bool) -> str:
    """A Latin word without letters that merely look like plain ones; phonetic spellings stay."""
    odd = [ch for ch in token if ch in LATIN_TWINS and not (dotless and ch == "ı")]
    rest = [ch for ch in token if ch not in LATIN_TWINS and unicodedata.category(ch)[0] != "M"]
    if not odd or not rest or not all(map(_is_plain, rest)):
        return token
    return "".join(LATIN_TWINS[ch] if ch in odd else ch for ch in token)


def _in_number(token: str, before: str, after: str) -> str | None:
    """The digits that a run of look-alikes stands for inside a number; None if it is no such run."""
    if not (before[-1:].isdecimal() and (after[:1].isdecimal() or before[-2:-1].isdecimal())):
        return None
    digits = [DIGITS.get(TWINS.get(ch) or LATIN_TWINS.get(ch, "")) for ch in token]
    return "".join(digits) if all(digits) else None


def unify(text: str) -> str:
    """The one form of ``text`` in which equal-looking texts are equal."""
    if text.isascii():
        return text
    if INVISIBLE.search(text):
        out = []
        for i, ch in enumerate(text):
            if INVISIBLE.match(ch) and not KEPT_FORMAT.match(ch):
                if ch in JOINERS and 0 < i < len(text) - 1 and JOINING.match(text[i - 1]) and JOINING.match(text[i + 1]):
                    out.append(ch)
                continue
            out.append(ch)
        text = "".join(out)
    text = "".join(map(plain_form, text))
    text = unicodedata.normalize("NFC", text)
    if text.isascii():
        return text
    tokens = TOKEN.findall(text)
    sure = [{s for ch in set(token) if ch not in TWINS for s in scripts_of(ch)} for token in tokens]
    counts = dict.fromkeys((*SCRIPTS, "Other"), 0)
    for own in sure:
        for s in own:
            counts[s] += 1
    home = max(counts, key=counts.get)
    at = iter(range(len(tokens)))

    def resolve(m: regex.Match) -> str:
        i = next(at)
        if m[0].isascii():
            return m[0]
        number = _in_number(m[0], text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 1])
        if number is not None:
            return number
        near = set().union(*(sure[j] for j in (i - 1, i + 1) if 0 <= j < len(sure) and len(sure[j]) == 1))
        return _plain_latin(_resolved(m[0], home, near), dotless)

    dotless = DOTLESS.search(text) is not None
    return unicodedata.normalize("NFC", TOKEN.sub(resolve, text))  # a resolved letter may meet an accent


@F.pandas_udf(StringType())
def _unify_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(unify, na_action="ignore")


def uniform(text: Column) -> Column:
    """``text`` in its one form.  Only texts beyond ASCII are sent to Python."""
    return F.coalesce(_unify_batches(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def question_texts(questions: DataFrame) -> DataFrame:
    """Every stem (``stem``, 0) and choice text (``text``, from 1) as a row.

    Null questions, null choices and null texts give no row; a null choice
    keeps its position.
    """
    stem = F.struct(F.lit("stem").alias("field_name"), F.lit(0).cast("bigint").alias("pos"), F.col("question.stem").alias("txt"))
    choices = F.transform(
        F.coalesce(F.col("question.choices.text"), F.array().cast("array<string>")),
        lambda t, i: F.struct(F.lit("text").alias("field_name"), (i + 1).cast("bigint").alias("pos"), t.alias("txt")),
    )
    return (
        questions.select("ord", F.explode(F.concat(F.array(stem), choices)).alias("f"))
        .select("ord", "f.field_name", "f.pos", "f.txt")
        .where("txt is not null")
    )


def uniform_questions(questions: DataFrame) -> DataFrame:
    """``ord, field_name, pos, txt, uniform_text`` of all texts of the bank."""
    return question_texts(questions).withColumn("uniform_text", uniform(F.col("txt")))


def standins(questions: DataFrame) -> DataFrame:
    """The texts that hold a stand-in."""
    return (
        uniform_questions(questions.select("ord", "question"))
        .where("uniform_text <> txt")
        .select("ord", "field_name", "pos")
    )
