"""The English stemmer of the Snowball project ("Porter2"), as columns over distinct terms.

Each step is a projection with regular expressions and suffix tables, so all of it stays in generated code. It runs once for
each distinct term of a corpus, not for each token: `stems` gives (term, stem), which an index or a question then joins.

The word's regions are kept as places: R1 begins after the first non-vowel behind a vowel, R2 is R1 of R1; a suffix lies in a
region if it begins at or after its place. Y stands for a y that is a consonant. Null terms have no row; terms of one or two
characters, and those of no Latin letters, are their own stems; terms are taken as lower-case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Words with a stem of their own.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}

#: Words that stay as step 1a leaves them.
LEFT = "inning outing canning herring earring proceed exceed succeed".split()

#: Suffixes of steps 2 to 4 and what takes their place.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

REGION = "^(?:gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])"
AGAIN = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"  # a short syllable at the end


def suffix(word: Column, of: list[str] | dict[str, str]) -> Column:
    """The longest suffix of those given, or '': a search from the left meets the longest first."""
    return F.regexp_extract(word, f"({'|'.join(of)})$", 1)


def cut(word: Column, n: Column | int) -> Column:
    """`word` without its last `n` characters."""
    return F.substr(word, F.lit(1), F.length(word) - n)


def begins(word: Column, ending: Column) -> Column:
    """Where a suffix begins."""
    return F.length(word) - F.length(ending)


def table(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def region(word: Column, pattern: str) -> Column:
    n = F.length(F.regexp_extract(word, pattern, 0))
    return F.when(n == 0, F.length(word)).otherwise(n)


def stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms in a column."""
    w, s, r1, r2 = F.col("w"), F.col("s"), F.col("r1"), F.col("r2")
    d = terms.select(F.col(column).alias("term")).where("term is not null").distinct()
    d = d.withColumn("w", F.regexp_replace(F.regexp_replace(F.regexp_replace("term", "^'", ""), "(^|[aeiouy])y", "$1Y"), "('s'|'s|')$", ""))
    d = d.withColumn("r1", region(w, REGION))
    d = d.withColumn("r2", r1 + region(F.substr(w, r1 + 1), AGAIN))

    # 1a: plurals
    d = d.withColumn("s", suffix(w, ["sses", "ied", "ies", "us", "ss", "s"]))
    lost = F.when(s == "sses", 2).when(s.isin("ied", "ies"), F.when(F.length(w) > 4, 2).otherwise(1)).when((s == "s") & w.rlike("[aeiouy].+s$"), 1).otherwise(0)
    d = d.withColumn("w", cut(w, lost))
    d = d.withColumn("left", w.isin(*LEFT))
    d = d.withColumn("kept", w)

    # 1b: past tenses and participles; 1c: final y
    d = d.withColumn("s", suffix(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"]))
    d = d.withColumn("b", cut(w, F.length("s")))
    b = F.col("b")
    mended = F.when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e"))).when(b.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), cut(b, 1)).when(b.rlike(SHORT) & (r1 >= F.length(b)), F.concat(b, F.lit("e"))).otherwise(b)
    d = d.withColumn("w", F.when(s.isin("eed", "eedly"), F.when(begins(w, s) >= r1, F.concat(b, F.lit("ee"))).otherwise(w)).when((s != "") & b.rlike("[aeiouy]"), mended).otherwise(w))
    d = d.withColumn("w", F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"))

    # 2 and 3: derivational suffixes, in R1
    d = d.withColumn("s", suffix(w, STEP2))
    fits = (begins(w, s) >= r1) & ((s != "ogi") | w.rlike("logi$")) & ((s != "li") | w.rlike("[cdeghkmnrt]li$"))
    d = d.withColumn("w", F.when((s != "") & fits, F.concat(cut(w, F.length(s)), F.element_at(table(STEP2), s))).otherwise(w))
    d = d.withColumn("s", suffix(w, STEP3))
    fits = (begins(w, s) >= r1) & ((s != "ative") | (begins(w, s) >= r2))
    d = d.withColumn("w", F.when((s != "") & fits, F.concat(cut(w, F.length(s)), F.element_at(table(STEP3), s))).otherwise(w))

    # 4: what is left of suffixes, in R2; 5: final e and l
    d = d.withColumn("s", suffix(w, STEP4))
    fits = (begins(w, s) >= r2) & ((s != "ion") | w.rlike("[st]ion$"))
    d = d.withColumn("w", F.when((s != "") & fits, cut(w, F.length(s))).otherwise(w))
    last = F.length(w) - 1
    e = w.endswith("e") & ((last >= r2) | ((last >= r1) & ~cut(w, 1).rlike(SHORT)))
    d = d.withColumn("w", F.when(e | (w.endswith("ll") & (last >= r2)), cut(w, 1)).otherwise(w))

    plain = F.translate(F.when(F.col("left"), F.col("kept")).otherwise(w), "Y", "y")
    stem = F.when(F.col("term").isin(*IRREGULAR), F.element_at(table(IRREGULAR), F.col("term"))).when(F.length("term") <= 2, F.col("term")).otherwise(plain)
    return d.select("term", stem.alias("stem"))
