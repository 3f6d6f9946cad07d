"""One consistent form for texts that look alike.

Texts with characters that may not be ordinary are mapped to their look-alikes: wide forms, ligatures, blanks, letters of
other scripts. The mapped values and their ordinary forms are then grouped under Unicode's accent-sensitive collation in
SQL, where invisible characters and the ways of writing an accent make no difference; each class gets one canonical member,
and the member is joined back.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Invisible characters, odd blanks, and letters of other scripts that look like Latin ones.
INVISIBLE = "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f\u0010\u0011\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b\u001c\u001d\u001e\u001f\u007f\u00ad\u034f\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
CYRILLIC, LATIN_FOR_CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝѵԍ", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwvg"
GREEK, LATIN_FOR_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ", "ABEZHIKMNOPTYXaivopu"
ARMENIAN, LATIN_FOR_ARMENIAN = "օսհոցՏՕ", "ouhngSO"

#: A character that may have another ordinary form: anything but the plain letters and marks of the collection. Java's syntax.
ODD = r"[^\t-~\u00A1-\u00AC\u00AE-\u02FF\u2010-\u2027\u2030-\u205E\u2070-\u20CF\u3001-\u303F\u4E00-\u9FFF\uFF01\uFF08\uFF09\uFF0C\uFF1A\uFF1B\uFF1F]"
ODD_CHARACTER = regex.compile(ODD.replace("\\uFF01\\uFF08\\uFF09\\uFF0C\\uFF1A\\uFF1B\\uFF1F]", "\\uFF01-\\uFF0F\\uFF1A-\\uFF20]"))
_CONTROL = r"[\x01-\x08\x0E-\x1F\x7F]"
_EASTERN_MARK, _EASTERN = r"[\uFF01-\uFF20]", r"[\u3040-\u30FF\u4E00-\u9FFF\uAC00-\uD7AF]"

_TWINS = dict(zip(CYRILLIC + GREEK + ARMENIAN, LATIN_FOR_CYRILLIC + LATIN_FOR_GREEK + LATIN_FOR_ARMENIAN))
_SCRIPTS = r"\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}\p{Lisu}"
_WORD = regex.compile(rf"[\p{{Latin}}{_SCRIPTS}\p{{M}}\d]+")
_LATIN = regex.compile(r"\p{Latin}")
_FOREIGN = regex.compile(f"[{_SCRIPTS}]")
_HIDDEN = regex.compile(f"[{INVISIBLE}]")
_EMOJI_JOIN = regex.compile(r"(?<=[\p{Extended_Pictographic}\uFE0F\U0001F3FB-\U0001F3FF])\u200D(?=\p{Extended_Pictographic})")
_SCRIPT_JOIN = regex.compile(r"(?<=[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Malayalam}\p{Telugu}\p{Kannada}\p{Sinhala}\p{Khmer}\p{Myanmar}]\p{M}*)[\u200C\u200D]")
_BLANK = regex.compile(f"[{BLANKS}]")
_WIDE = regex.compile(r"[\uFF10-\uFF19\uFF21-\uFF3A\uFF41-\uFF5A\uFF61-\uFF9F\uFB00-\uFB06\u2E80-\u2FD5\uF900-\uFAFF\U0001D400-\U0001D7FF\u2126\u212A\u212B\u2160-\u217F]")
_WIDE_MARK = regex.compile(r"[\uFF01-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF5E]")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


def twins(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts that look like a Latin letter: the confusables data of the Unicode library that comes with Spark, and the fixed ones above. Without that data there is no table: the fixed letters alone would leave look-alikes in the texts, and nobody could tell.

    Greek letters stand beside Latin ones in formulas: of those only the fixed ones count.
    """
    letters = regex.findall(rf"[{_SCRIPTS}&&\p{{L}}&&[^\p{{Greek}}]]", "".join(map(chr, range(0x370, 0xD800))), regex.V1)
    try:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        shapes = checker.getSkeleton("\n".join(letters)).split("\n")
    except Exception as e:  # another Unicode library, or none in reach
        raise RuntimeError("no look-alikes: com.ibm.icu.text.SpoofChecker, which comes with Spark, does not answer in the driver's JVM") from e
    if len(shapes) != len(letters):
        raise RuntimeError(f"no look-alikes: {len(shapes)} shapes for {len(letters)} letters")
    # what the library takes for 1 or l alike is told by the fixed letters
    return {c: s for c, s in zip(letters, shapes) if len(s) == 1 and s.isascii() and s.isalpha() and s != "l"} | _TWINS


def _untwin(word: str, table: dict[str, str]) -> str:
    """Latin letters for those of other scripts, in a word that also has Latin ones."""
    return "".join(table.get(c, c) for c in word) if _LATIN.search(word) and _FOREIGN.search(word) else word


def look_alikes(text: str, table: dict[str, str] = _TWINS) -> str:
    """Odd blanks as blanks, full-width letters and digits, ligatures, radicals and compatibility letters in their plain forms, look-alike letters as Latin ones in words that also have Latin letters.

    Chinese punctuation stays in texts with Chinese, as do superscripts, dashes, formula letters and whole words of other scripts.
    """
    out = _BLANK.sub(" ", text).replace("\u2028", "\n").replace("\u2029", "\n")
    out = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), out)
    if _WIDE_MARK.search(out) and not _EAST.search(out):
        out = _WIDE_MARK.sub(lambda m: unicodedata.normalize("NFKC", m.group()), out)
    return _WORD.sub(lambda m: _untwin(m.group(), table), out) if _FOREIGN.search(out) else out


def ordinary(text: str, table: dict[str, str] = _TWINS) -> str:
    """The text in ordinary characters: its look-alikes without invisible characters (joiners inside emoji and in scripts that need them stay), letter and combining accent one character. Applying it again changes nothing."""
    keep = {m.start() for p in (_EMOJI_JOIN, _SCRIPT_JOIN) for m in p.finditer(text)} if "\u200d" in text or "\u200c" in text else ()
    out = _HIDDEN.sub(lambda m: m.group() if m.start() in keep else "", text)
    return unicodedata.normalize("NFC", look_alikes(out, table))


@F.pandas_udf(T.StringType())
def _ordinary_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else ordinary(t))


def ordinary_column(col: str) -> Column:
    """Ordinary forms: only texts with odd characters are sent to Python; plain ASCII is told by its length in bytes."""
    c = F.col(col)
    odd = c.rlike(ODD) | (c.rlike(_EASTERN_MARK) & ~c.rlike(_EASTERN))
    return F.coalesce(_ordinary_udf(F.when((F.octet_length(c) != F.length(c)) & odd, c)), c)


_ODD_TEXT = "mapped string, plain string"


def unify(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, canonical text, changed: every stored row once.

    Null texts stay null and unchanged, empty ones empty. Rows that repeat are all kept. Texts with characters that may not
    be ordinary, their look-alikes and the ordinary forms of those fall into classes that are equal under the collation
    UNICODE (accents and case count, what cannot be seen does not); all get the shortest member of their class, among
    equals the first in code-point order. A text of nothing but ordinary characters is its own class's member: under that
    collation it equals no other such text. keys need not identify a row. Other columns, whatever their names, are ignored.
    """
    spark = texts.sparkSession
    table = twins(spark)
    base = texts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text_col).alias("stored"))
    c = F.col("stored")
    odd = F.coalesce(F.when(F.octet_length(c) != F.length(c), c.rlike(ODD) | (c.rlike(_EASTERN_MARK) & ~c.rlike(_EASTERN))).otherwise(c.rlike(_CONTROL)), F.lit(False))

    @F.pandas_udf(_ODD_TEXT)
    def mapped(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"mapped": [look_alikes(t, table) for t in s], "plain": [ordinary(t, table) for t in s]})

    found = base.where(odd).select(F.md5("stored").alias("key"), F.length("stored").alias("size"), mapped("stored").alias("m"))
    # blocks keep the collation to texts with the same letters; equal strings under it have the same letters in their ordinary forms
    letters = F.regexp_replace("m.plain", r"[^\p{L}\p{N}]+", "")
    members = found.select("key", F.md5(F.when(letters == "", F.col("m.plain")).otherwise(letters)).alias("block"), F.explode(F.array("m.mapped", "m.plain")).alias("value"), F.col("m.mapped").alias("mapped")).distinct()
    # {members} is a relation of this query only; nothing is registered in the session
    classes = spark.sql(
        """
        SELECT key, min_by(canonical, struct(length(canonical), canonical)) AS canonical
        FROM (
          SELECT key, min_by(value, struct(length(value), value)) OVER (PARTITION BY block, collate(value, 'UNICODE')) AS canonical, value, mapped
          FROM {members}
        )
        WHERE value = mapped
        GROUP BY key
        """,
        members=members,
    )
    odd_rows = base.where(odd).withColumn("key", F.md5("stored")).join(classes, "key").select(*[f"k{i}" for i in range(len(keys))], "stored", "canonical")
    out = base.where(~odd).withColumn("canonical", F.col("stored")).select(*[f"k{i}" for i in range(len(keys))], "stored", "canonical").unionByName(odd_rows)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "canonical", (~F.col("canonical").eqNullSafe(F.col("stored"))).alias("changed"))
