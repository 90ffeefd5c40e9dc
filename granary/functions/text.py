"""Scalar text operators as Column expressions; all run in the JVM.

Word runs are matched as maximal runs of letters, digits and underscores and then filtered, since word boundaries differ
between regular-expression engines and Java versions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English stopwords, the usual public list.
STOPWORDS = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
    himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that
    that'll these those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after above below to from
    up down in out on off over under again further then once here there when where why how all any both each few more
    most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll
    m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't
    ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't
    wouldn wouldn't""".split()
)
# End of fixed values.

#: Letters of Latin-1 and Latin Extended-A/B with the letter that is left without their combining marks.
ACCENTS = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and all(map(unicodedata.combining, d[1:]))}


#: A running header as a pattern; corpora name their own.
SAMPLE_HEADER = r"Annual.*?Manual"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(text: Column | str) -> Column:
    """Latin letters without their accents."""
    return F.translate(col(text), "".join(ACCENTS), "".join(ACCENTS.values()))


def word_runs(text: Column | str) -> Column:
    """Maximal runs of letters, digits and underscores; null text has none."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def raw_terms(text: Column | str) -> Column:
    """Lower-case terms that begin with an ASCII letter and go on with ASCII letters and digits."""
    return F.transform(F.filter(word_runs(text), lambda w: w.rlike("^[a-zA-Z][a-zA-Z0-9]*$")), F.lower)


def tokenize(text: Column | str) -> Column:
    """raw_terms without stopwords."""
    return F.filter(raw_terms(text), lambda w: ~w.isin(*STOPWORDS))


def adjacent(terms: Column | str) -> Column:
    """Each term joined to the next one by a space."""
    t = col(terms)
    return F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.greatest(F.lit(0), F.size(t) - 1)), F.slice(t, F.lit(2), F.greatest(F.lit(0), F.size(t) - 1)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def shingles_k(terms: Column | str, k: int) -> Column:
    """Distinct runs of k terms; fewer terms give one shingle of all, none give none, as does k < 1."""
    t = col(terms)
    none = F.array().cast("array<string>")
    if k < 1:
        return none
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - (k - 1))), lambda i: F.array_join(F.slice(t, i, F.lit(k)), " "))
    return F.when(F.size(t) == 0, none).otherwise(F.array_distinct(runs))


def shingles_ub(terms: Column | str) -> Column:
    """Distinct terms and pairs of adjacent ones."""
    return F.array_distinct(F.concat(col(terms), adjacent(terms)))


def vectorizer_tokens(text: Column | str) -> Column:
    """Lower-case runs of two or more word characters, without accents."""
    return F.filter(word_runs(F.lower(strip_accents(text))), lambda w: F.length(w) >= 2)


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """Texts in the composed form of compatible characters, without characters that are no valid text."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t.encode("utf-8", "ignore").decode("utf-8")), na_action="ignore")


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def extracted(text: Column | str) -> Column:
    """Text as a page reader should hand it on: ligatures apart, words joined over line ends."""
    return F.regexp_replace(_decomposed(col(text)), "-\n", "")


def clean(text: Column | str, header: str = SAMPLE_HEADER) -> Column:
    """The ordered cleaning steps; header names the running header whose lines (ending in a page number) go."""
    t = _composed(col(text))
    t = F.regexp_replace(t, "-\n", "")
    t = F.regexp_replace(t, "([^\n])\n([^\n])", "$1 $2")
    t = F.regexp_replace(t, "([^\n])\n([^\n])", "$1 $2")
    t = F.regexp_replace(t, rf"(?im)^[ \t]*{header}.*?\d+[ \t]*$", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*\d+[ \t]*$", " ")
    t = F.regexp_replace(t, "[ \t]+", " ")
    # not F.trim by itself: transform would give it each part's index as the characters to trim
    parts = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(parts, "\n\n")


def is_contents_page(text: Column | str) -> Column:
    """At least eight runs of four or more dots, or five lines that end in dots and a page number."""
    leaders = F.size(F.regexp_extract_all(col(text), F.lit(r"(\.{4,})"), F.lit(1)))
    lines = F.size(F.filter(F.split(col(text), "\n"), lambda line: line.rlike(r"\.{3,}\s*\d+\s*$")))
    return (leaders >= 8) | (lines >= 5)


def has_table(text: Column | str) -> Column:
    return F.coalesce(col(text).contains(" | "), F.lit(False))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != ""))


def text_quality(text: Column | str) -> Column:
    """The share of letters."""
    return F.length(F.regexp_replace(col(text), r"[^\p{L}]", "")) / F.greatest(F.lit(1), F.length(col(text)))


def snippet(text: Column | str, size: int = 240) -> Column:
    """White space collapsed, cut after size characters with an ellipsis."""
    t = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("…"))).otherwise(t)


def sentences(text: Column | str) -> Column:
    return F.split(col(text), r"(?<=[.!?])\s+")


def answer_terms(text: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(r"([A-Za-z0-9]+)"), F.lit(1)), F.lower))


def reference_keys(text: Column | str) -> Column:
    """Numbers of the sections, articles and clauses that a text refers to."""
    t = F.coalesce(col(text), F.lit(""))
    found = [F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (r"[Ss]ection\s+(\d+(?:\.\d+)*)", r"[Aa]rticle\s+(\d+)", r"[Cc]lause\s+(\d+)")]
    return F.array_distinct(F.concat(*found))


def title_keys(title: Column | str) -> Column:
    """Numbers in a title that no letter, digit or underscore touches."""
    t = F.coalesce(col(title), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?<![\p{L}\p{N}_])(\d+(?:\.\d+)*)(?![\p{L}\p{N}_])"), F.lit(1)))


def term_overlap(text: Column | str, query: Column | str) -> Column:
    """The share of the query's distinct raw terms that the text has."""
    q = F.array_distinct(raw_terms(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(F.array_distinct(raw_terms(text)), q)) / F.size(q), 4)).otherwise(F.lit(0.0))


def citations(answer: Column | str, excerpts: Column) -> Column:
    """Numbers of the excerpts that an answer cites: `excerpt N` anywhere, all integers of lines that speak of citing."""
    t = F.coalesce(col(answer), F.lit(""))
    named = F.regexp_extract_all(t, F.lit(r"(?i)excerpts?\s*#?\s*(\d+)"), F.lit(1))
    cited = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"(?i)\b(cite|cited|citation|citations)\b"))
    listed = F.flatten(F.transform(cited, lambda line: F.regexp_extract_all(line, F.lit(r"(\d+)"), F.lit(1))))
    numbers = F.transform(F.concat(named, listed), lambda n: n.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= excerpts)))


def before(word: Column) -> Column:
    """A pattern that cuts a text before each hit of a word, overlapping ones too."""
    return F.concat(F.lit("(?=\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
