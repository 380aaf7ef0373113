"""Text functions as native column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import fixed


def let(value: Column, use) -> Column:
    """``use`` of a value worked out once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, by the ICU library that Spark ships; plain ASCII is stable and passes as it is."""
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False)), composed).otherwise(text)


def count_tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")).cast("int")


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _repair_numbers(lowered: Column) -> Column:
    """In runs of digits mixed with l, i, o, and standing alone, read the letters as digits."""

    def repaired(runs):
        def one(x, i):
            before = F.substring(F.coalesce(F.get(runs, i - 1), F.lit("")), -1, 1)
            behind = F.substring(F.coalesce(F.get(runs, i + 1), F.lit("")), 1, 1)
            alone = ~before.rlike("[a-z0-9]") & ~behind.rlike("[a-z0-9]")
            return F.when(x.rlike("^[0-9lio]{2,}$") & x.rlike("[0-9]") & alone, F.translate(x, "lio", "110")).otherwise(x)

        return F.array_join(F.transform(runs, one), "")

    mended = let(F.regexp_extract_all(lowered, F.lit(r"(?s)[0-9lio]+|[^0-9lio]+"), F.lit(0)), repaired)
    return F.when(lowered.rlike(r"[0-9][lio]|[lio][0-9]"), mended).otherwise(lowered)


def _expand(token: Column) -> Column:
    """``19(1)(g)`` to 19, 19(1), 19(1)(g); a plain word to itself; a stop word to nothing."""
    parts = F.regexp_extract_all(token, F.lit(r"\([0-9a-z]+\)"), F.lit(0))
    base = F.regexp_extract(token, r"^\d+[a-z]{0,3}", 0)
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(base, F.array_join(F.slice(parts, 1, i), "")))
    plain = F.when(token.isin(fixed.STOPWORDS), F.array().cast("array<string>")).otherwise(F.array(token))
    return F.when(F.contains(token, F.lit("(")), steps).otherwise(plain)


def tokens(text: Column) -> Column:
    """Index and query terms of the NFKC form in text order; null gives an empty array.

    Repairs and references need a digit, so texts without one take one pattern and one filter; texts that hold a
    reference are expanded token by token.
    """

    def plain(lowered):
        return F.filter(F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: ~t.isin(fixed.STOPWORDS))

    def numbered(lowered):
        mixed = F.regexp_extract_all(lowered, F.lit(rf"{fixed.REFERENCE}|[\p{{L}}\p{{N}}]+"), F.lit(0))
        expanded = F.flatten(F.transform(mixed, lambda t: _expand(F.regexp_replace(t, r"\s", ""))))
        return F.when(lowered.rlike(fixed.REFERENCE), expanded).otherwise(plain(lowered))

    def found(lowered):
        repaired = let(F.regexp_replace(_repair_numbers(lowered), fixed.FIRST_CLAUSE, "$1(1)"), numbered)
        return F.when(lowered.rlike("[0-9]"), repaired).otherwise(plain(lowered))

    return let(F.lower(nfkc(F.coalesce(text, F.lit("")))), found)


def _without_suffix(word: Column, least: int, to_y: list[str], rest: list[str]) -> Column:
    """The longest ending off that leaves ``least`` letters.  One pattern each, so that a lambda works a word out once."""
    y = "|".join(to_y)
    plain = F.regexp_replace(word, rf"^(.{{{least},}}?)(?:{'|'.join(rest)})$", "$1")
    return F.when(word.rlike(rf"^.{{{least},}}(?:{y})$"), F.regexp_replace(word, rf"(?:{y})$", "y")).otherwise(plain)


def light_stem(word: Column) -> Column:
    """Common English endings off; for coverage checks, never for the index."""
    rest = ["(?<!s)s" if s == "s" else s for s in fixed.LIGHT_SUFFIXES if s not in ("ied", "ies")]
    cut = F.when((F.length(word) > 4) & ~word.rlike(r"\d$"), _without_suffix(word, 3, ["ied", "ies"], rest)).otherwise(word)
    return F.regexp_replace(cut, "^(.{4,})e$", "$1")


def claim_stem(word: Column) -> Column:
    """Endings off for claim checks; tokens with digits and short ones stay."""
    rest = [s for s in fixed.CLAIM_SUFFIXES if s not in ("ied", "ies", "ural")]
    cut = F.when(word.rlike("^.{4,}ural$"), F.regexp_replace(word, "ural$", "ure")).otherwise(_without_suffix(word, 4, ["ied", "ies"], rest))
    return F.when(word.rlike(r"\d") | (F.length(word) <= 4), word).otherwise(F.regexp_replace(cut, "^(.{4,})e$", "$1"))


def is_one_typo(word: Column, name: Column) -> Column:
    """One letter inserted, deleted or replaced, or two neighbours swapped; both of six letters or more, and no inflection."""
    size = F.length(word)
    sized = (size >= 6) & (F.length(name) >= 6) & (F.abs(size - F.length(name)) <= 1) & (F.substring(word, 1, 1) == F.substring(name, 1, 1))
    inflected = F.startswith(word, name) | F.startswith(name, word)
    # a swap of neighbours leaves the sorted letters as they are and changes exactly two adjacent places
    differ = F.filter(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)) != F.substring(name, i, F.lit(1)))
    first, second = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    swapped = (size == F.length(name)) & (F.size(differ) == 2) & (second == first + 1) & (F.substring(word, first, F.lit(1)) == F.substring(name, second, F.lit(1))) & (F.substring(word, second, F.lit(1)) == F.substring(name, first, F.lit(1)))
    return (word != name) & sized & ~inflected & ((F.levenshtein(word, name) == 1) | F.coalesce(swapped, F.lit(False)))


def article_refs(text: Column) -> Column:
    """References behind 'Article(s)' with their clauses and without spaces, in order, once each: ``19(1)(g)``."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?i){fixed.ARTICLE_BLOCK}"), F.lit(1))

    def found(block):
        # a block is plain ASCII, so its numbers stand in its upper case as well
        numbers = F.regexp_extract_all(F.upper(block), F.lit(fixed.ARTICLE_NUMBER), F.lit(1))
        clauses = F.regexp_extract_all(block, F.lit(fixed.ARTICLE_NUMBER), F.lit(2))
        return F.zip_with(numbers, clauses, lambda n, c: F.concat(n, F.translate(c, " \t\n\x0b\f\r", "")))

    return F.array_distinct(F.flatten(F.transform(blocks, found)))


def articles_of(refs: Column) -> Column:
    return F.array_distinct(F.transform(refs, lambda r: F.regexp_extract(r, r"^[0-9A-Z]+", 0)))


def mentions_article(text: Column, article: Column) -> Column:
    """'Article 21', 'Arts. 14, 19 and 21', but not a bare 21."""
    pattern = F.concat(F.lit(r"\bart(?:icle)?s?\.?\s+(?:[\w()]+(?:\s*,\s*|\s+and\s+|\s*&\s*))*"), F.lower(article), F.lit(r"(?![\w])"))
    return F.regexp_like(normalize_space(F.lower(text)), pattern)


def coverage(terms: Column, text: Column, matched_articles: Column) -> Column:
    """Share of the terms that the text holds as they are, as word forms, or as a matched article."""

    def share(forms):
        hits = F.filter(terms, lambda t: F.array_contains(forms, t) | F.array_contains(forms, light_stem(t)) | F.array_contains(matched_articles, F.upper(t)))
        return F.size(hits) / F.size(terms)

    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(let(let(F.array_distinct(tokens(text)), lambda own: F.array_union(own, F.transform(own, light_stem))), share))


def canonical_quote(text: Column) -> Column:
    """Quote and dash styles unified, lower case, single spaces: for finding quotations."""
    return normalize_space(F.lower(F.translate(text, "’‘“”–—", "''\"\"--")))


def canonical_claim(text: Column) -> Column:
    """Without quote marks and punctuation: for finding claims that stand verbatim in the evidence."""
    bare = F.regexp_replace(F.lower(text), "[“”\"‘’'`]", "")
    return normalize_space(F.regexp_replace(bare, r"(?U)[^\w()]+", " "))


def truncate_words(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut between words and marked."""
    head = F.substring(text, 1, limit)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(fixed.ELLIPSIS.rstrip())))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slash at the end; the path keeps its case."""
    trimmed = F.trim(url)
    scheme = F.lower(F.regexp_extract(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(F.regexp_replace(trimmed, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    tail = F.regexp_replace(F.regexp_replace(rest, r"^[^/?]*", ""), r"/+(?=$|\?)", "")
    return F.when(scheme == "", trimmed).otherwise(F.concat(scheme, F.lit("://"), host, tail))


def strip_markers(text: Column) -> Column:
    """Without evidence markers, and without the spaces they leave before punctuation."""
    bare = normalize_space(F.regexp_replace(text, fixed.MARKER, " "))
    return F.trim(F.regexp_replace(bare, r"\s+([.;,?!])", "$1"))


def marker_ids(text: Column) -> Column:
    """Evidence ids of all markers, in order, once each."""
    marks = F.regexp_extract_all(text, F.lit(f"({fixed.MARKER})"), F.lit(1))
    numbers = F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit(r"(\d+)"), F.lit(1))))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("E"), n.cast("int").cast("string"))))


def header_like(line: Column) -> Column:
    """At most 12 words, and at least seven tenths of the letters are capitals."""
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    return (F.size(F.split(F.trim(line), r"\s+")) <= 12) & (letters > 0) & (F.regexp_count(line, F.lit(r"\p{Lu}")) >= 0.7 * letters)


def line_key(line: Column) -> Column:
    """A line with its digits made alike."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\s+", " "), r"\d+", "#")


def fuzzy_key(line: Column) -> Column:
    """The first twelve letters of a line."""
    return F.substring(F.regexp_replace(F.lower(line), "[^a-z]", ""), 1, 12)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


#: Words of a claim that cannot be checked.
GENERIC = sorted({*fixed.GENERIC_CLAIM_WORDS, *fixed.STOPWORDS, *fixed.NEGATORS})


#: A word before the dots at a piece's end that ends no sentence; a lower-cased capital i with a dot is two letters.
_NO_END = r"(?U)(?:^|[^\w'])(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in a) for a in fixed.ABBREVIATIONS) + r"|[\w'&&[^\u0130]])\.+[\"'”’)]*$"


def sentences(text: Column) -> Column:
    """Array of the sentences of a text, with single spaces; abbreviations and initials end none.

    Every candidate place becomes a line end; a piece whose last word cannot end a sentence is joined with the next one.
    Only what stands behind a piece's last space is looked at.
    """

    def closed(piece):
        goes_on = F.substring_index(F.rtrim(piece), " ", -1).rlike(_NO_END)
        return F.when(goes_on, piece).otherwise(F.concat(piece, F.lit("\n")))

    pieces = F.split(F.regexp_replace(normalize_space(F.coalesce(text, F.lit(""))), f"({fixed.SENTENCE_BOUNDARY})", "$1\n"), "\n")
    joined = F.split(F.array_join(F.transform(pieces, closed), ""), "\n")
    return F.filter(F.transform(joined, lambda s: F.trim(s)), lambda s: s != "")


def spoken_words(text: Column) -> Column:
    """Words in order in lower case, n't as not."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), f"(?U){fixed.NOT_CONTRACTED}", " not"), F.lit(fixed.SPOKEN_WORD), F.lit(0))


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), claim_stem))


def content_stems(words: Column) -> Column:
    """Stems of the words that can be checked, once each."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(GENERIC)), claim_stem))


def claim_terms(text: Column) -> Column:
    return content_stems(tokens(F.regexp_replace(text, f"(?U){fixed.NOT_CONTRACTED}", " not")))


def denied_stems(words: Column) -> Column:
    """Stems in the scope of a negator: the four words behind it."""
    scopes = F.transform(words, lambda w, i: F.when(w.isin(fixed.NEGATORS), F.slice(words, i + 2, 4)).otherwise(F.array().cast("array<string>")))
    return content_stems(F.flatten(scopes))


def entities(text: Column) -> Column:
    """Numbers, and capitalised names; a sentence's first word counts only as the start of a longer name."""
    numbers = F.filter(F.array_distinct(tokens(text)), lambda t: t.rlike("[0-9]") & ~F.contains(t, F.lit("(")))

    def named(words):
        def is_name(w, i):
            after = F.coalesce(F.get(words, i + 1), F.lit(""))
            starts = (i > 0) | (after.rlike(r"^\p{Lu}") & ~F.lower(after).isin(fixed.GENERIC_CAPITALIZED))
            return starts & (F.length(w) > 2) & w.rlike(r"^\p{Lu}") & ~F.regexp_replace(F.lower(w), "^[’']+|[’']+$", "").isin(fixed.GENERIC_CAPITALIZED)

        return F.filter(words, is_name)

    names = F.flatten(F.transform(sentences(text), lambda s: let(F.regexp_extract_all(s, F.lit(f"(?U){fixed.NAME_WORD}"), F.lit(0)), named)))
    return F.array_distinct(F.concat(numbers, names))


def unverified_quotations(text: Column, sources: Column) -> Column:
    """Quotations of four words or more that stand in none of the sources; an ellipsis stands for what is left out."""
    quotes = F.transform(F.regexp_extract_all(text, F.lit(fixed.QUOTED), F.lit(0)), lambda q: F.substr(q, F.lit(2), F.length(q) - 2))
    long = F.filter(quotes, lambda q: F.size(F.split(normalize_space(q), " ")) >= 4)
    held = F.transform(sources, canonical_quote)

    def parts(q):
        return F.filter(F.transform(F.split(q, fixed.GAP), lambda p: F.btrim(canonical_quote(p), F.lit(" ,;."))), lambda p: p != "")

    return F.filter(long, lambda q: F.forall(held, lambda s: F.exists(parts(q), lambda p: ~F.contains(s, p))))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "“[^”]*”|\"[^\"]*\"", " ")
