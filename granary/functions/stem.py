"""The Porter stemmer, after M. F. Porter, An algorithm for suffix stripping (1980), applied to distinct terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The suffix rules of steps 2 to 4 of the paper.
STEP_2 = "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
STEP_3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
# End of fixed values.

RULES_2, RULES_3 = ([tuple((r.strip() + " ").split(" ")[:2]) for r in step.split(",")] for step in (STEP_2, STEP_3))


def shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x and y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def longest(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, to in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + to if measure(base) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        base = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
        if base is not None and "v" in shape(base):
            word = base
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif double_end(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and short_end(word):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = longest(longest(word, RULES_2), RULES_3)
    for suffix in sorted(STEP_4.split(), key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not short_end(word[:-1])):
        word = word[:-1]
    if measure(word) > 1 and double_end(word) and word.endswith("l"):
        word = word[:-1]
    return word


_known: dict[str, str] = {}


def known(word: str) -> str:
    """stem(word), remembered for a bounded number of words."""
    found = _known.get(word)
    if found is None:
        if len(_known) >= 1 << 18:
            _known.clear()
        found = _known[word] = stem(word)
    return found


@F.arrow_udf(ArrayType(StringType()))
def _stem_arrays(terms: pa.Array) -> pa.Array:
    """Each distinct term of a batch is looked up once."""
    coded = pc.list_flatten(terms).dictionary_encode()
    stems = pa.array([None if t is None else known(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(terms), 0)), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), stems, mask=pc.is_null(terms))


def stemmed(tokens: DataFrame) -> DataFrame:
    """tokens with each term's stem in its place: terms stay in their row, nothing is shuffled."""
    return tokens.withColumn("terms", _stem_arrays("terms"))


@F.pandas_udf(StringType())
def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(stem, na_action="ignore")


def stem_terms(rows: DataFrame, term: str = "term") -> DataFrame:
    """rows with the column stem; each distinct term is stemmed once."""
    stems = rows.select(term).distinct().withColumn("stem", _stems(F.col(term)))
    return rows.join(stems, term)
