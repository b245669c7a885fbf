"""Text: normalisation, cleaning, tokens, n-grams, set similarity, prompts and reply parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType

#: Stop words, Portuguese then English.
STOPWORDS = tuple(
    "de da do das dos em na no nas nos com por para que se um uma uns umas os as ao aos à às ou e mas não este esta estes estas esse essa isso isto "
    "ele ela eles elas seu sua seus suas meu minha foi são mais como bem muito também já quando ainda "
    "the a an and or but in on at to for of with is are was were be been has have had that this these those it its by from we our their "
    "which who how what where when while than can will may not also such both each more most there using used use based study paper results data analysis "
    "research approach method model framework between across".split()
)
#: Marks of a retraction or correction in a title, English then Portuguese.
RETRACTION_MARKS = (
    r"\bretraction\b", r"\bretracted\b", r"\berratum\b", r"\bcorrigendum\b", r"\bcorrection to\b", r"\bexpression of concern\b",
    r"\bwithdrawal\b", r"\bwithdrawn\b", r"\bpublisher's note\b", r"\beditor.s note\b",
    r"\bretrata[çc][aã]o\b", r"\bretratado\b", r"\bcorre[çc][aã]o\b", r"\bpreocupa[çc][aã]o editorial\b", r"\bretirada\b", r"\berrata\b",
)
#: Phrases that try to steer a model that reads the text.
INJECTION_MARKS = (
    r"ignore\s+(?:all\s+)?(?:previous|prior|above|the)\s+instructions?",
    r"ignore\s+(?:as\s+)?instru[çc][õo]es\s+(?:anteriores|acima|pr[ée]vias)",
    r"disregard\s+(?:all\s+)?(?:previous|prior|the)\s+",
    r"desconsidere\s+(?:as\s+)?instru[çc][õo]es",
    r"(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be)\b",
    r"(?:system|assistant|user)\s*:\s*",
    r"</?(?:system|instructions?|prompt)>",
    r"set\s+(?:cluster_\w+|epi_\w+|\w+)\s+to\s+\d",
    r"classify\s+(?:this\s+)?as\s+\w+",
    r"classifique\s+(?:isto\s+)?como\s+\w+",
    r"output\s+(?:only|exactly|the\s+following)",
    r"responda\s+(?:apenas|exatamente|somente)\s+com",
    r"<<<\s*article_(?:begin|end)\s*>>>",
    r"new\s+instructions?\s*:",
    r"novas?\s+instru[çc][õo]es\s*:",
)
#: Inline citations and tags that cleaning takes out of a text.
NUMERIC_CITATION = r"\[\d[\d,;\-\s]*\]"
AUTHOR_CITATION = r"\([A-ZÀ-Ö][a-zà-ö]+(\s[A-ZÀ-Ö][a-zà-ö]+)*(?:\s(?:&|and|et al\.?)\s[A-ZÀ-Ö][a-zà-ö]+)*(?:[\.,]\s?\d{4}[a-z]?)?\)"
TAG = r"<[^>]{1,50}>"
#: Letters that tokens keep, and the markers around an article in a prompt.
TOKEN_LETTERS = "a-záàâãäéèêëíìîïóòôõöúùûüçñ0-9"
BEGIN, END = "<<<ARTICLE_BEGIN>>>", "<<<ARTICLE_END>>>"
#: Positions beyond this make an inverted index invalid.
MOST_POSITION = 10_000


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no function for it."""
    return text.str.normalize("NFC")


def strip(text: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise_title(title: Column, compose: bool = True) -> Column:
    """Lower case, punctuation to spaces, spaces squeezed. compose=False skips NFC for text known to be composed."""
    out = F.lower(nfc(title) if compose else title)
    return strip(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", " "), r"\s+", " "))


def normalise_doi(doi: Column) -> Column:
    return F.lower(F.trim(doi))


def citations(text: Column) -> Column:
    """Inline citations that clean_text() takes out of text without tags."""
    plain = F.regexp_replace(text, TAG, " ")
    return F.regexp_count(plain, F.lit(NUMERIC_CITATION)) + F.regexp_count(F.regexp_replace(plain, NUMERIC_CITATION, " "), F.lit(AUTHOR_CITATION))


def clean_text(text: Column, compose: bool = True) -> Column:
    """Tags, citations and control characters out (a line feed becomes a space), spaces squeezed, empty is null."""
    out = nfc(text) if compose else text
    for pattern in (TAG, NUMERIC_CITATION, AUTHOR_CITATION):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, r"[\p{Cc}&&[^\n]]", "")
    out = strip(F.regexp_replace(F.replace(out, F.lit("\n"), F.lit(" ")), r"\s{2,}", " "))
    return F.when(F.length(out) > 0, out)


def count_words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_count(text, F.lit(r"(?U)\w+"))


def count_word_pieces(text: Column) -> Column:
    """All pieces between word boundaries, spaces and punctuation too."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|\s|[^\w\s]"))


def composed(df: DataFrame, column: str) -> DataFrame:
    """df with the column in NFC; for tokens(), whose list functions can't hold a Python function."""
    return df.withColumn(column, nfc(F.col(column)))


def tokens(text: Column, stop: Iterable[str] = STOPWORDS) -> Column:
    """Lower-case tokens of three characters or more, without stop words and numbers; [] under ten characters. Text is in NFC."""
    out = F.regexp_replace(F.lower(text), rf"[^{TOKEN_LETTERS}\s]", " ")
    words = F.filter(F.split(out, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^[0-9]+$"))
    words = F.filter(words, lambda w: ~w.isin(*stop))
    return F.when(F.length(text) >= 10, words).otherwise(F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it: list functions evaluate their arguments anew at
    each mention, but a lambda's variable is bound."""
    return F.transform(F.array(value), body)[0]


def ngrams(words: Column, most: int = 3) -> Column:
    """All n-grams of 1 to `most` words, in order of n, repeats kept, by zipping neighbours."""

    def longer(own: Column, words_: Column, n: int) -> Column:
        tail = F.slice(words_, n, F.greatest(F.size(words_), F.lit(1)))
        return F.filter(F.zip_with(own, tail, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b))), lambda g: g.isNotNull())

    def all_of(words_: Column, own: Column, n: int) -> Column:
        if n > most:
            return own
        return let(longer(own, words_, n), lambda grams: F.concat(own, all_of(words_, grams, n + 1)))

    return let(words, lambda w: all_of(w, w, 2))


#: Function words by language, as many of each, none of them shared.
FUNCTION_WORDS = {
    "de": ("der", "die", "und", "das", "nicht", "mit", "ist", "ein", "eine", "von", "sich", "auf"),
    "en": ("the", "of", "and", "is", "that", "was", "for", "with", "this", "are", "from", "which"),
    "es": ("el", "los", "las", "del", "y", "con", "una", "lo", "su", "pero", "muy", "donde"),
    "fr": ("le", "les", "des", "et", "dans", "est", "une", "pour", "qui", "sur", "avec", "au"),
    "pt": ("o", "os", "do", "da", "dos", "em", "um", "uma", "com", "não", "ao", "pela"),
}


def language_by_words(text: Column, words: dict[str, tuple[str, ...]] = FUNCTION_WORDS, least: int = 2) -> Column:
    """The language most of whose function words the text has, `least` at least and more than any other's; else null."""

    def count(tokens_: Column, own: tuple[str, ...]) -> Column:
        return F.size(F.filter(tokens_, lambda w: w.isin(*own)))

    def of(tokens_: Column) -> Column:
        counts = F.array(*(F.struct(count(tokens_, own).alias("n"), F.lit(lang).alias("lang")) for lang, own in sorted(words.items())))
        return let(F.sort_array(counts, asc=False), lambda c: F.when((c[0]["n"] >= least) & (c[0]["n"] > c[1]["n"]), c[0]["lang"]))

    return let(F.split(F.lower(text), r"\s+"), of)


def iso_utc(stamp: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC, to the second (sessions run in UTC)."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalise_term(term: Column) -> Column:
    """Lower case; letters, underscore, slash, space and hyphen stay; spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(term)), r"[^a-zñáàâãäéèêëíîïóôõöúûüç_/ -]", ""), r"\s+", " "))


def split_terms(terms: Column) -> Column:
    """A list of terms in one string, cut at commas, semicolons and bars."""
    return F.split(terms, r"[,;|]\s*")


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def coverage(terms: Column, lexicon: Column) -> Column:
    """Share of terms in the lexicon; 0 without terms."""
    n = F.size(F.array_distinct(terms))
    return F.when(n > 0, F.size(F.array_intersect(terms, lexicon)) / n).otherwise(F.lit(0.0))


@F.pandas_udf(MapType(StringType(), ArrayType(IntegerType())))
def inverted_index(text: pd.Series) -> pd.Series:
    """Word -> positions of a text cut at spaces. In Python: list functions would look for each word in the whole text."""

    def build(own: str | None) -> dict[str, list[int]] | None:
        if own is None:
            return None
        out: dict[str, list[int]] = {}
        for i, w in enumerate(own.split(" ")):
            out.setdefault(w, []).append(i)
        return out

    return text.map(build)


def rebuild_abstract(index: Column) -> Column:
    """A text from its inverted index word -> positions.

    Negative positions are skipped; a position beyond MOST_POSITION makes the whole text empty; gaps leave empty words;
    of words at one position the last in the map wins."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e, k: F.transform(e["value"], lambda p: F.struct(p.alias("p"), k.alias("k"), e["key"].alias("w")))))
    flat = F.array_sort(F.filter(flat, lambda x: x["p"] >= 0))

    def build(entries: Column) -> Column:
        rest = F.slice(entries, 2, F.greatest(F.size(entries), F.lit(1)))
        with_next = F.zip_with(entries, rest, lambda x, y: F.struct(x["p"].alias("p"), x["w"].alias("w"), y["p"].alias("q")))
        return let(F.filter(with_next, lambda x: x["q"].isNull() | (x["q"] != x["p"])), spaced)  # the last of equal positions

    def spaced(words: Column) -> Column:
        before = F.slice(F.concat(F.slice(words, 1, 1), words), 1, F.greatest(F.size(words), F.lit(1)))
        gaps = F.zip_with(words, before, lambda x, y: F.concat(F.repeat(F.lit(" "), x["p"] - y["p"]), x["w"]))  # a space for each place
        return F.when(F.size(words) == 0, F.lit("")).when(F.element_at(words, -1)["p"] > MOST_POSITION, F.lit("")).otherwise(F.trim(F.array_join(gaps, "")))

    return let(flat, build)


def rebuild_abstract_compact(index: Column) -> Column:
    """Words in order of position, without gaps."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " ")


def marks(text: Column, patterns: Iterable[str]) -> Column:
    """Whether any of the patterns occurs, whatever the case."""
    return F.coalesce(text.rlike("(?iu)(?:" + "|".join(patterns) + ")"), F.lit(False))


def injection_reason(title: Column, abstract: Column, patterns: Iterable[str] = INJECTION_MARKS, most: int = 5) -> Column:
    """The first five distinct matches in alphabetical order, joined; empty if none."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    found = F.regexp_extract_all(text, F.lit("(?iu)(?:" + "|".join(patterns) + ")"), F.lit(0))
    found = F.array_sort(F.array_distinct(F.transform(found, lambda m: F.lower(strip(m)))))
    return F.array_join(F.slice(found, 1, most), "; ")


def user_message(title: Column, abstract: Column) -> Column:
    """Title and abstract, cut to 500 and 3000 characters, between markers; forged end markers go after the cut."""
    cut = lambda c, n: F.replace(F.substring(strip(F.coalesce(c, F.lit(""))), 1, n), F.lit(END), F.lit(""))
    return F.concat(F.lit(f"{BEGIN}\nTITLE: "), cut(title, 500), F.lit("\n\nABSTRACT: "), cut(abstract, 3000), F.lit(f"\n{END}"))


def prompt_version(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt.cast("binary"), 256), 1, 12)


def json_object(text: Column) -> Column:
    """A text that is one JSON object, as a variant; else null. (The parser alone would take a text's first value.)"""
    return F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")), F.try_parse_json(text))


def parse_reply(text: Column, numbers: Iterable[str], strings: Iterable[str] = ()) -> Column:
    """Fields of a model's reply: its JSON, else its first {...} without inner braces, else field by field.

    A struct of the fields and `fallback`, true where the reply as a whole was no JSON object."""
    whole = json_object(strip(text))
    block = json_object(F.regexp_extract(text, r"(?s)\{[^{}]+\}", 0))
    value = F.coalesce(whole, block)
    fields = []
    for name, kind, pattern in [*((n, "double", r"([0-9.]+)") for n in numbers), *((n, "string", r'"(\w+)"') for n in strings)]:
        single = F.nullif(F.regexp_extract(text, rf'"{name}"\s*:\s*{pattern}', 1), F.lit(""))
        fields.append(F.when(value.isNotNull(), F.try_variant_get(value, f"$.{name}", kind)).otherwise(single.try_cast(kind)).alias(name))
    return F.struct(*fields, whole.isNull().alias("fallback"))


def parse_fenced_reply(text: Column, numbers: Iterable[str]) -> Column:
    """As parse_reply, from the first { to the last }, code fences or not."""
    value = json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    return F.struct(*(F.try_variant_get(value, f"$.{n}", "double").alias(n) for n in numbers), value.isNull().alias("fallback"))
