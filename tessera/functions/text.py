"""Scalar functions over text and identifiers, as column expressions. Character classes are ASCII unless said otherwise."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Spellings of a missing knowledge-base link.
EMPTY_LINKS = ("", "none", "null", "nil", "-1", "nan", "None")
#: Words that alone are no key phrase.
STOPWORDS = ("a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "by", "is", "are", "was", "were", "be", "been", "it", "this", "that", "as", "at")
#: Ranges of characters that count as emoji.
EMOJI = ((0x1F300, 0x1F9FF), (0x1FA00, 0x1FAFF), (0x2700, 0x27BF), (0x2600, 0x26FF))
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of several fields, of those that a table has, that is not null; an empty string counts as present."""
    return F.coalesce(*[F.col(c) for c in names if c in df.columns], F.lit(None))


def sample_id(explicit, ident, uid, model) -> Column:
    """Explicit id, else an id that holds ``__``, else uid__model (slashes and spaces to _), else the id, else ''."""
    explicit, ident, uid, model = map(_c, (explicit, ident, uid, model))
    pair = F.translate(F.concat(uid, F.lit("__"), model), "/ ", "__")
    return F.coalesce(explicit, F.when(ident.contains("__"), ident), pair, ident, F.lit(""))


def flat_text(text, sents=None) -> Column:
    """A text, or the words of its sentences joined by spaces."""
    return _c(text) if sents is None else F.coalesce(_c(text), F.array_join(F.flatten(_c(sents)), " "))


def squeeze(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"[ \t\n\r\f\x0B]+", " "))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark lacks."""
    return x.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))


def clean_post(x, normalise: bool = True, retweet: bool = False, emoji: bool = False, style: str = "plain") -> Column:
    """Line ends and white space, then links, user names, a leading RT mark, hash signs and emoji. Classes are of Unicode."""
    url, user = ("<URL>", "<USER>") if style == "angle" else ("URL", "USER")
    x = F.coalesce(nfkc(_c(x)) if normalise else _c(x), F.lit(""))
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[\t\n]+", " "), " +", " "), r"(?U)^\s+|\s+$", "")
    x = F.regexp_replace(x, r"(?iU)https?://\S+|www\.\S+", url)
    x = F.regexp_replace(x, r"(?U)@\w+", user)
    if retweet:
        x = F.regexp_replace(x, r"(?iU)^RT\s+", "")
    x = F.regexp_replace(x, r"(?U)#(\w+)", "$1")
    if emoji:
        x = F.trim(F.regexp_replace(F.regexp_replace(x, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI) + "]+", ""), " +", " "))
    return x


def time_key(x) -> Column:
    """struct(missing, key): times in ISO form, other text as it is, blanks last."""
    x = _c(x)
    t = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in TIME_FORMATS])
    blank = F.coalesce(F.trim(x) == "", F.lit(True))
    return F.struct(blank.cast("int").alias("missing"), F.when(~blank, F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), x)).otherwise("").alias("key"))


def sentences(x) -> Column:
    """Pieces after . ! or ? and white space; blank ones go."""
    marked = F.regexp_replace(_c(x), r"([.!?])[ \t\n\r\f\x0B]+", "$1\x1e")
    return F.filter(F.split(marked, "\x1e"), lambda s: F.trim(s) != "")


def words(x) -> Column:
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z0-9]+"), F.lit(0))


def keyphrases(x, most: int = 8) -> Column:
    """Phrases of a list in text: parted at | ; , and line ends, without numbering and quotes; no empty or stop-word
    phrases, no repeats but for case, none that a longer one contains; in order, ``most`` at most."""
    parts = F.transform(F.split(_c(x), r"[|\n;,]+"), lambda p: F.trim(F.regexp_replace(F.trim(p), r"^[0-9]+[).\]] *", "")))
    parts = F.transform(parts, lambda p: F.regexp_replace(p, "^[\"' ]+|[\"' ]+$", ""))
    parts = F.filter(parts, lambda p: F.exists(F.regexp_extract_all(F.lower(p), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS)))
    low = F.transform(parts, lambda p: F.lower(p))
    first = F.filter(parts, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)
    kept = F.filter(first, lambda p: ~F.exists(low, lambda q: (F.length(q) > F.length(p)) & q.contains(F.lower(p))))
    return F.slice(kept, 1, most)


def yes_no(x) -> Column:
    """1 or 0 by the first word yes or no, else null."""
    return F.when(F.regexp_extract(F.lower(_c(x)), r"\b(yes|no)\b", 1) == "yes", 1).when(F.regexp_extract(F.lower(_c(x)), r"\b(yes|no)\b", 1) == "no", 0)


def stars(x) -> Column:
    """The first digit 1-5, else null."""
    d = F.regexp_extract(_c(x), "[1-5]", 0)
    return F.when(d != "", d.cast("int"))


def json_part(x) -> Column:
    """The text if it is a JSON object, else its span from the first { to the last }, else null."""
    span = F.regexp_extract(_c(x), r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(span, "$").isNotNull(), span)


def verdict(x) -> Column:
    """The upper-case ``label`` of a JSON reply if it is one of the three verdicts."""
    label = F.upper(F.get_json_object(json_part(x), "$.label"))
    return F.when(label.isin("SUPPORTED", "CONTRADICTED", "NOT_ENOUGH_INFORMATION"), label)


def evidence_missing(label, evidence, source) -> Column:
    """Whether a supporting reply cites text that the source lacks."""
    return (_c(label) == "SUPPORTED") & (F.coalesce(_c(evidence), F.lit("")) != "") & ~F.contains(F.lower(_c(source)), F.lower(_c(evidence)))


def finite(x) -> Column:
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def directed(x, distance: Column | bool = False, lower_better: Column | bool = False) -> Column:
    """A finite score so that higher is better; others null."""
    d, b = (v if isinstance(v, Column) else F.lit(v) for v in (distance, lower_better))
    x = finite(x)
    x = F.when(d, -x).otherwise(x)
    return F.when(b, -x).otherwise(x)


def zero_if_missing(x) -> Column:
    return F.nanvl(F.coalesce(_c(x).cast("double"), F.lit(0.0)), F.lit(0.0))


def kb_id(wikidata, wikipedia=None, name=None) -> Column:
    """wd:<id>, else wiki:<id>, else null; without outer spaces, empty spellings as written. The name stands in only where there is no ``wikipedia`` column at all."""
    ok = lambda x: F.when(~F.trim(x.cast("string")).isin(*EMPTY_LINKS), F.trim(x.cast("string")))
    other = wikipedia if wikipedia is not None else name
    parts = [F.concat(F.lit("wd:"), ok(_c(wikidata)))] + ([F.concat(F.lit("wiki:"), ok(_c(other)))] if other is not None else [])
    return F.coalesce(*parts)


def split_id(x) -> Column:
    """struct(key, side) of ids that end in _candidate or _humman_summary, else null."""
    m = lambda k: F.regexp_extract(_c(x), r"^(?s)(.*)(_candidate|_humman_summary)$", k)
    return F.when(m(2) != "", F.struct(m(1).alias("key"), F.when(m(2) == "_candidate", "candidate").otherwise("human").alias("side")))


def bare(x) -> Column:
    """Lower case, with a space for every character that is no letter, digit or white space."""
    return F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9 \t\n\r\f\x0B]", " ")


def is_linked(wikidata) -> Column:
    """Whether an entity has a link; empty spellings in either case."""
    return F.coalesce(~F.lower(F.trim(_c(wikidata))).isin(*sorted({x.lower() for x in EMPTY_LINKS})), F.lit(False))


def linked(wikidata):
    """``is_linked`` of an Arrow array, as a numpy mask."""
    empty = {x.lower() for x in EMPTY_LINKS}
    coded = wikidata.dictionary_encode()
    known = [x is not None and x.strip(" ").lower() not in empty for x in coded.dictionary.to_pylist()]
    return np.array([*known, False], dtype=bool)[coded.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)]


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def token_jaccard(a, b) -> Column:
    """Jaccard similarity of word sets; null if either is empty."""
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), jaccard(x, y))


def char_grams(x, n: int = 3) -> Column:
    s = F.replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9 \t\n\r\f\x0B]", " "), F.lit(" "), F.lit(""))
    s = F.regexp_replace(s, r"[\t\n\r\f\x0B]", "")
    return F.when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))))


def char_jaccard(a, b, n: int = 3) -> Column:
    return jaccard(char_grams(a, n), char_grams(b, n))


def overlap(phrase, sentence) -> Column:
    """Part of the phrase's distinct words that the sentence has."""
    p = F.array_distinct(words(phrase))
    return F.try_divide(F.size(F.array_intersect(p, words(sentence))).cast("double"), F.size(p).cast("double"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (gestalt matching), which no built-in gives."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def digest(*columns) -> Column:
    """SHA-256 of one text, or of the JSON of several columns."""
    return F.sha2(_c(columns[0]), 256) if len(columns) == 1 else F.sha2(F.to_json(F.struct(*[_c(x) for x in columns])), 256)


def ngrams(w: Column, n: int) -> Column:
    """Runs of n words joined by spaces; none if there are fewer. Words are zipped with themselves, so each is read n times."""
    out = w
    for k in range(1, n):
        out = F.zip_with(out, F.slice(w, F.lit(k + 1), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(out, F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0)))
