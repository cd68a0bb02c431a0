"""One consistent form for texts that look the same, by DuckDB SQL inside Arrow partitions.

What is folded: every compatibility form of Unicode that is drawn like what it stands for (full and half width, font and
position variants, ligatures, squared words, abbreviations such as the numero sign, radicals), canonical composition, the kind
of blank, line ends, characters that draw nothing, hyphens and slashes drawn alike, single Hangul letters, and letters of
Cyrillic, Greek, Armenian, Cherokee and Lisu drawn like Latin ones. What is kept: case, accents, digits, words, tabs, number and
kind of visible marks, super- and subscripts, circled forms, letter variants of another shape (long s, Greek symbols), and
the joiner inside emoji sequences, where it changes what is drawn.

Null stays null, the empty text stays empty. Texts are never shortened; the form is a fixed point (folding twice changes
nothing). Texts of ASCII characters only need no more than the line ends, which the SQL decides text by text.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnset.session import cut, salted_join

# Letters of other scripts that common fonts draw like the Latin letter below them.
_CYRILLIC = "аеорсухіјѕһӏԁԛԝАВЕКМНОРСТУХІЈЅӀԌԚԜ"
_AS_LATIN = "aeopcyxijshldqwABEKMHOPCTYXIJSIGQW"
_GREEK = "ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
_AS_LATIN_2 = "ovcjABEZHIKMNOPTYXCJ"
_ARMENIAN = "օցհոսՕՍԼ"
_AS_LATIN_3 = "oghnuOUL"
_CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ"
_AS_LATIN_4 = "DRTAJEWMHGZVSLCPKB"
_LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
_AS_LATIN_5 = "BPDTGKJCZFMNLSRVHWXYAEIOU"
_LATIN = "ɑɡ"
_AS_LATIN_6 = "ag"
# Marks drawn alike, and the one that stands for them.
_MARKS = "‐‑∕"
_AS_MARK = "--⁄"
# Code points that draw nothing (joiners are treated apart).
_NOTHING = ["00AD", "034F", "061C", "115F", "1160", "17B4", "17B5", "180B-180F", "200B", "200C", "200E", "200F", "202A-202E", "2060-206F", "3164", "FE00-FE0F", "FEFF", "FFA0", "FFF9-FFFB", "E0000-E0FFF"]
# Compatibility forms of another shape than what they stand for.
_OTHER_SHAPE = "ſẛϐϑϒϓϔϕϖϰϱϴϵ"
_FORMS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<compat>", "<square>", "<small>", "<vertical>", "<fraction>")
_EMOJI = r"\x{00A9}\x{00AE}\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2900}-\x{297F}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}"
_HELD = "\U0010fffe"


@functools.cache
def _alike() -> dict[str, str]:
    pairs = ((_CYRILLIC, _AS_LATIN), (_GREEK, _AS_LATIN_2), (_ARMENIAN, _AS_LATIN_3), (_CHEROKEE, _AS_LATIN_4), (_LISU, _AS_LATIN_5), (_LATIN, _AS_LATIN_6), (_MARKS, _AS_MARK))
    return {x: y for a, b in pairs for x, y in zip(a, b, strict=True)}


@functools.cache
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """One character for one, several for one, and single Hangul letters after composition: by rule from the Unicode data."""
    alike = _alike()
    single, several, jamo = {}, {}, {}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        tag, *parts = unicodedata.decomposition(c).split(" ")
        if unicodedata.category(c) == "Zs":
            single[c] = " "
        elif tag == "<compat>" and 0x3131 <= i <= 0x318E:  # conjoining letters that were not joined are drawn like these
            jamo.setdefault(chr(int(parts[0], 16)), c)
        elif tag in _FORMS and c not in _OTHER_SHAPE:
            to = chr(int(parts[0], 16)) if 0xFFA1 <= i <= 0xFFDC else unicodedata.normalize("NFKC", c)
            if to[0] == " " or to == c:  # spacing accents have no other form
                continue
            to = "".join(alike.get(x, x) for x in to)
            (single if len(to) == 1 else several)[c] = to
        elif tag and not tag.startswith("<"):  # an accented look-alike has the accented Latin letter as its form
            nfd = unicodedata.normalize("NFD", c)
            if nfd[0] in alike:
                to = unicodedata.normalize("NFC", alike[nfd[0]] + nfd[1:])
                if len(to) == 1:
                    single[c] = to
    single |= alike | {"\u2028": "\n", "\u2029": "\n", "\u0085": "\n"}
    return single, several, jamo


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.cache
def several_pattern() -> str:
    return "[" + "".join(_tables()[1]) + "]"


@functools.lru_cache(256)
def folding_sql(text: str = "text", present: tuple[str, ...] | None = None) -> str:
    """The one form of a text; `present`: the characters among those drawn as several that the texts hold (default: all)."""
    single, several, jamo = _tables()
    lines = f"regexp_replace({text}, '\\r\\n?', chr(10), 'g')"
    nothing = "".join("-".join(rf"\x{{{p}}}" for p in x.split("-")) for x in _NOTHING)
    join = f"regexp_replace({lines}, '[{nothing}]', '', 'g')"
    for _ in range(2):  # twice: neighbouring joints share a character
        join = f"regexp_replace({join}, '([{_EMOJI}])\\x{{200D}}([{_EMOJI}])', '\\1{_HELD}\\2', 'g')"
    plain = wide = f"regexp_replace({join}, '\\x{{200D}}', '', 'g')"
    for a in several if present is None else present:
        wide = f"replace({wide}, {_quoted(a)}, {_quoted(several[a])})"
    if wide != plain:
        wide = f"CASE WHEN regexp_matches({text}, {_quoted('[' + ''.join(several if present is None else present) + ']')}) THEN {wide} ELSE {plain} END"
    folded = f"nfc_normalize(translate(nfc_normalize({wide}), {_quoted(''.join(single))}, {_quoted(''.join(single.values()))}))"
    return f"""CASE WHEN strlen({text}) = length({text}) THEN {lines} ELSE
      replace(translate({folded}, {_quoted(''.join(jamo))}, {_quoted(''.join(jamo.values()))}), '{_HELD}', chr(8205)) END"""


def fold_texts(df: DataFrame, text: str, keep: list[str], into: str = "canonical") -> DataFrame:
    """The columns `keep` and the one form of `text` as column `into`."""
    if into in keep:
        raise ValueError(f"{into} is already a column")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(into, T.StringType())])
    pattern = several_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        try:
            for b in batches:
                con.register("part", pa.table({"text": b.column(b.schema.get_field_index(text))}))
                found = con.sql(f"SELECT DISTINCT unnest(regexp_extract_all(text, {_quoted(pattern)})) FROM part WHERE strlen(text) > length(text)").fetchall()
                sql = folding_sql('"text"', tuple(sorted(c for c, in found)))
                done = con.sql(f"SELECT {sql} AS folded FROM part").to_arrow_table().column(0).combine_chunks()
                con.unregister("part")
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], done.cast(pa.string())], names=[*keep, into])
        finally:
            con.close()

    return df.select(*keep, text).mapInArrow(run, schema) if text not in keep else df.select(*keep).mapInArrow(run, schema)


def look_classes(members: DataFrame, salts: int = 8) -> tuple[DataFrame, DataFrame]:
    """members(id, class, raw) to the classes that hold more than one raw text: (class, raw, representative, n_ids) and the ids with class and raw.

    The representative is the smallest raw text of the class; a class of any size costs as many rows as it has members. Rows
    without an id, a class or a raw text belong to none.
    """
    members = members.where("id is not null and class is not null and raw is not null")
    raws = members.groupBy("class", "raw").agg(F.count(F.lit(1)).alias("n_ids"))
    mixed = raws.groupBy("class").agg(F.min("raw").alias("representative"), F.count(F.lit(1)).alias("n_raws")).where("n_raws > 1").select("class", "representative")
    classes = salted_join(raws, mixed, "class", salts=salts)
    return classes.select("class", "raw", "representative", "n_ids"), salted_join(members, mixed.select("class"), "class", salts=salts).select("id", "class", "raw")


def same_looking_pairs(members: DataFrame, salts: int = 8) -> DataFrame:
    """members(id, class, raw) to pairs (id_a, id_b) of one class and different raw texts, smaller id first.

    A view over the classes for those who want every pair: raw text against raw text and not row against row, so exact
    copies of one text are never compared with each other and every joined row is a row of the result. Both joins are salted on
    the side that may hold a hot class.
    """
    classes, inside = look_classes(members, salts)
    classes = cut(classes)
    deal = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    a = classes.select("class", F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("raw"), F.lit(salts)).cast("int").alias("salt"))
    b = classes.select("class", F.col("raw").alias("raw_b"), deal)
    pairs = a.join(b, ["class", "salt"]).where("raw_a < raw_b").select("raw_a", "raw_b")
    left = salted_join(inside.select(F.col("raw").alias("raw_a"), F.col("id").alias("x")), pairs, "raw_a", salts=salts)
    both = salted_join(left, inside.select(F.col("raw").alias("raw_b"), F.col("id").alias("y")), "raw_b", salts=salts)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
