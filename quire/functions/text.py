"""Text functions as Spark columns: normal forms, counts, classification, residue checks and cleaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import lexicon as L

#: Letters with accents and what is left of them; other compositions of the scripts used here do not occur.
ACCENTED, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: A word beside a letter with an accent is no ASCII word.
_ASCII_TOKEN = r"(?U)\b[A-Za-z][A-Za-z.-]*\b"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def among(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def normalize(t) -> Column:
    return F.trim(F.regexp_replace(col(t), r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def noise_form(t) -> Column:
    return F.btrim(F.lower(normalize(t)), F.lit(L.EDGE_PUNCTUATION))


def repetition_key(t) -> Column:
    paged = F.regexp_replace(F.lower(normalize(t)), r"(?U)\bpage\s+\d+\b", "page <n>")
    return F.regexp_replace(paged, r"(?U)\b\d+\b", "<n>")


def semantic_form(t) -> Column:
    return F.lower(normalize(t))


def token_form(t) -> Column:
    return F.lower(F.btrim(col(t), F.lit(L.EDGE_PUNCTUATION)))


def table_form(t) -> Column:
    return F.lower(F.translate(col(t), ACCENTED, PLAIN))


def table_token(t) -> Column:
    return table_form(F.btrim(col(t), F.lit(L.EDGE_PUNCTUATION)))


def find_all(t, pattern: str) -> Column:
    return F.regexp_extract_all(col(t), F.lit(pattern), F.lit(0))


def word_count(t) -> Column:
    return F.size(find_all(t, r"(?U)\b[\w'-]+\b"))


def ascii_tokens(t) -> Column:
    return find_all(t, _ASCII_TOKEN)


def ascii_words(t) -> Column:
    return find_all(t, r"[A-Za-z][A-Za-z'-]*")


def is_upper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


def starts_upper(x: Column) -> Column:
    return is_upper(F.left(x, F.lit(1)))


def title_case(x: Column) -> Column:
    rest = F.substring(x, 2, 1 << 30)
    return starts_upper(x) & (F.lower(rest) == rest) & (F.upper(rest) != rest)


# Classification of lines.


def is_list_item(t) -> Column:
    return col(t).rlike(r"(?U)^\s*([-*•‣▪]|\d+[.)]|[A-Za-z][.)])\s+") | col(t).rlike(r"(?iU)^\s*(Q|A)\s*[:.-]\s+")


def is_footnote(t, size, avg, y0, height) -> Column:
    return col(t).rlike(r"(?U)^\s*(\[\d+\]|\d+[.)]|\d+)\s+") & ((col(size) <= col(avg) - 1) | (col(y0) >= 0.65 * col(height)))


def is_caption(t, size, avg) -> Column:
    low = F.lower(col(t))
    return col(t).rlike(r"(?iU)^\s*(fig\.?|figure|table)\s+\d+") | ((col(size) <= col(avg) - 1) & (low.startswith("source:") | low.startswith("caption:")))


def is_title(t, size, avg, y0, bold, height) -> Column:
    t, size, avg = col(t), col(size), col(avg)
    marks = F.length(F.regexp_replace(t, "[^.,;:!?]", ""))
    large = (size >= F.greatest(F.lit(14.0), avg + 1.5)) | (col(bold) & (size >= avg)) | ((col(y0) <= 0.35 * col(height)) & (size >= avg + 1))
    return (size > 0) & (F.length(t) <= 120) & (marks / F.greatest(F.length(t), F.lit(1)) <= 0.08) & large


def words_split(t) -> Column:
    return F.filter(F.split(normalize(t), " "), lambda x: x != "")


def classify(t, size, avg, y0, y1, bold, height) -> Column:
    """Type of a line: the first kind that fits, then page edges for all but titles."""
    kind = (
        F.when(is_list_item(t), "list_item").when(is_footnote(t, size, avg, y0, height), "footnote").when(is_caption(t, size, avg), "caption")
        .when(is_title(t, size, avg, y0, bold, height), "title").when(F.size(words_split(t)) >= 4, "paragraph").otherwise("unknown")
    )
    return edge_type(kind, y0, y1, height)


def edge_type(kind: Column, y0, y1, height) -> Column:
    return F.when(kind == "title", kind).when(col(y0) <= 0.06 * col(height), "header").when(col(y1) >= 0.92 * col(height), "footer").otherwise(kind)


def confidence(kind) -> Column:
    pairs = [F.lit(x) for kv in L.ROLE_CONFIDENCE.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[col(kind)], F.lit(0.5))


def is_decorative(t, kind) -> Column:
    """A short label without a type that decorates a page."""
    text = normalize(t)
    words = find_all(text, "[A-Za-z]+")
    n, digit = F.size(words), text.rlike(r"(?U)\d")
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    label = (n <= 4) & ~text.rlike(r"[.!?;:]$") & ~digit & F.forall(words, lambda w: F.length(w) <= 6) & (capital >= 0.6 * n)
    return (col(kind) == "unknown") & F.when(text == "", True).when(n == 0, F.length(text) <= 3).otherwise(label | ((F.length(text) <= 2) & ~digit))


def is_short_title(t, size) -> Column:
    words = find_all(normalize(t), r"[A-Za-z][A-Za-z-]*")
    n = F.size(words)
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    return ((col(size) >= 14) & (F.length(normalize(t)) >= 4)) | ((n >= 1) & (n <= 5) & (capital >= 0.8 * n) & (F.length(normalize(t)) >= 8))


def is_noise(t, kind, size) -> Column:
    """Fragments that are no document text; containment in other blocks is a join (``contained``)."""
    text, kind = normalize(t), col(kind)
    words = find_all(text, r"[A-Za-z][A-Za-z-]*")
    n = F.size(words)
    name = (n >= 1) & (n <= 3) & F.forall(words, lambda w: w.rlike("^[A-Z][a-z]+$"))
    verb = text.rlike(rf"(?iU)\b({L.VERBS})\b") | text.rlike(rf"(?U)\b[A-Za-z]+(?:{L.VERB_ENDINGS})\b")
    return (
        F.when(among(kind, ["image", "header", "footer", "noise", "list_item", "caption", "footnote"]), False)
        .when((kind == "title") & is_short_title(t, size), False).when(text == "", True).when(among(noise_form(text), L.NOISE_PHRASES), True)
        .when(among(noise_form(text), L.SHORT_TERMS) | ((n >= 1) & F.forall(words, lambda w: among(F.lower(w), L.SHORT_TERMS))) | name, False).otherwise((n >= 1) & (n <= 3) & ~text.rlike("[.!?:;]") & ~verb)
    )


# Merging of fragments.


def is_short_fragment(t) -> Column:
    n = F.size(words_split(t))
    return (n >= 1) & (n <= 3) & (F.length(normalize(t)) <= 36)


def continues(t) -> Column:
    first = F.left(normalize(t), F.lit(1))
    return (first != "") & (F.lower(first) == first) & (F.upper(first) != first)


def acronym_pair(a, b) -> Column:
    """One text is an acronym of at least two capitals that starts the initials of two or more words of the other."""
    def one_way(short: Column, long: Column) -> Column:
        words = words_split(long)
        initials = F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), "")
        return short.rlike("^[A-Z]{2,}$") & (F.size(words) >= 2) & initials.startswith(short)

    a, b = normalize(a), normalize(b)
    return one_way(a, b) | one_way(b, a)


def join_texts(a, b) -> Column:
    """Text of two merged fragments."""
    a, b = normalize(a), normalize(b)
    low_a, low_b, short_a = F.lower(a), F.lower(b), a.rlike("^[A-Z]{2,}$")
    return (
        F.when(acronym_pair(a, b), F.when(short_a, F.concat(b, F.lit(" ("), a, F.lit(")"))).otherwise(F.concat(a, F.lit(" ("), b, F.lit(")"))))
        .when(low_a.contains(low_b), a).when(low_b.contains(low_a), b)
        .when(a.endswith("-"), F.concat(F.left(a, F.length(a) - 1), b)).otherwise(F.concat_ws(" ", a, b))
    )


# Residue of the source language.


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: the expression does not grow with its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def drop_phrases(t: Column) -> Column:
    """Takes known phrases off the end, longest first; a full stop before one stays, with a space."""
    def drop(phrase: str):
        pattern = rf"(?iU)([\s,;:\-.]+){phrase}[\s.!,;:]*$"

        def one(x: Column) -> Column:
            dotted = F.regexp_extract(x, pattern, 1).contains(".")
            cut = F.when(dotted, F.regexp_replace(x, pattern, ". ")).otherwise(F.regexp_replace(x, pattern, ""))
            return F.when(x.rlike(pattern), F.rtrim(cut, F.lit(" ,;:-"))).otherwise(x)

        return one

    out = t
    for phrase in L.RESIDUAL_PHRASES:
        out = let(out, drop(phrase))
    return F.when(t.rlike(r"(?iU)(" + "|".join(L.RESIDUAL_PHRASES) + r")[\s.!,;:]*$"), out).otherwise(t)


def clean_line(t: Column) -> Column:
    def last(x: Column) -> Column:
        words = words_split(x)
        cut = F.rtrim(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "), F.lit(" ,;:-"))
        return F.when((F.size(words) > 1) & among(token_form(F.try_element_at(words, F.lit(-1))), L.RESIDUAL_WORDS), cut).otherwise(x)

    return let(let(F.trim(t), drop_phrases), last)


def clean_artifacts(t) -> Column:
    lines = F.transform(F.split(col(t), "\n", -1), clean_line)
    return F.trim(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def has_residual(t) -> Column:
    """A residual phrase, or a residual word that is neither acronym nor part of a name."""
    low = F.lower(normalize(t))
    phrase = low.rlike(r"(?U)\b(" + "|".join(L.RESIDUAL_PHRASES) + r")\b")
    tokens = ascii_tokens(t)
    bad = F.transform(tokens, lambda x, i: among(token_form(x), L.RESIDUAL_WORDS) & ~(
        among(x, L.PROTECTED_ACRONYMS) | (is_upper(x) & (F.length(x) > 1))
        | (title_case(x) & (F.coalesce(title_case(F.get(tokens, i - 1)), F.lit(False)) | F.coalesce(title_case(F.get(tokens, i + 1)), F.lit(False))))
    ))
    return phrase | F.exists(bad, lambda x: x)


def too_many_english(t) -> Column:
    words = find_all(F.lower(col(t)), "[A-Za-z]+")
    n, k = F.size(words), F.size(F.filter(words, lambda w: among(w, L.COMMON_ENGLISH)))
    return (n >= 6) & (k >= 3) & (k >= 0.25 * n)


def is_suspicious(t, kind) -> Column:
    text = normalize(t)
    words = F.transform(find_all(text, "[A-Za-z]+"), F.lower)
    n = F.size(words)
    return (
        F.when(F.length(text) < 3, True).when(n == 0, True).when((n <= 3) & F.forall(words, lambda w: among(w, L.QUESTION_WORDS)), True)
        .when(among(col(kind), ["title", "caption", "footnote", "list_item"]), False).otherwise((n <= 2) & ~text.rlike("[.!?:;]"))
    )


def suffix_tokens(source, translated) -> Column:
    """Trailing words of the translation that are in the source too, up to the first other or protected word."""
    own = F.array_distinct(F.transform(find_all(source, "[A-Za-z][A-Za-z.-]*"), table_token))

    def stops(x: Column, known: Column) -> Column:
        return among(F.btrim(x, F.lit(L.EDGE_PUNCTUATION)), L.PROTECTED_ACRONYMS) | ~F.array_contains(known, table_token(x)) | (table_token(x) == "")

    def cut(s: Column) -> Column:
        first = F.array_position(F.transform(F.reverse(s["tokens"]), lambda x: stops(x, s["own"])), True)
        n = F.when(first == 0, F.size(s["tokens"])).otherwise(first - 1).cast("int")
        return F.slice(s["tokens"], F.size(s["tokens"]) - n + 1, n)

    return let(F.struct(ascii_tokens(translated).alias("tokens"), own.alias("own")), cut)


def suffix_prefix(translated, tokens: Column) -> Column:
    """The text before the run of trailing tokens, right-trimmed: the tokens go one by one from the end."""
    # the last occurrence of the last token is its place, as no other token follows it
    def before(text: Column, token: Column) -> Column:
        return F.left(text, F.length(text) - F.instr(F.reverse(text), F.reverse(token)) - F.length(token) + 1)

    return F.rtrim(F.aggregate(F.reverse(tokens), col(translated), before))


def is_name_suffix(tokens: Column) -> Column:
    low = F.transform(tokens, table_token)
    return (F.size(tokens) > 0) & ~F.exists(low, lambda x: among(x, L.PARAGRAPH_KEYWORDS)) & F.forall(tokens, title_case)


def is_removable_suffix(prefix: Column, tokens: Column) -> Column:
    keyword = F.exists(tokens, lambda x: among(table_token(x), L.PARAGRAPH_KEYWORDS))
    sentence = F.right(prefix, F.lit(1)).isin(".", "!", "?", ";", ":")
    n = F.size(tokens)
    return (prefix != "") & (n > 0) & ~is_name_suffix(tokens) & ((sentence & (keyword | (n >= 3))) | ((n >= 4) & keyword))


def clean_paragraph(source, translated) -> Column:
    """Cuts a trailing run of source words that is no name; never to nothing.  Two rounds: a run is maximal, so a
    second can only follow what the first cut's trimming uncovers."""
    def once(text: Column) -> Column:
        def use(s: Column) -> Column:
            cut = F.rtrim(s["prefix"], F.lit(" ,;:-"))
            return F.when(is_removable_suffix(s["prefix"], s["tokens"]) & (cut != "") & ~text.startswith("[FR MOCK]"), cut).otherwise(text)

        return let(let(suffix_tokens(source, text), lambda k: F.struct(k.alias("tokens"), suffix_prefix(text, k).alias("prefix"))), use)

    return let(let(normalize(translated), once), once)


def paragraph_needs_review(source, translated) -> Column:
    tokens = suffix_tokens(source, translated)
    return (F.size(tokens) > 0) & ~is_name_suffix(tokens) & ~is_removable_suffix(suffix_prefix(translated, tokens), tokens)


#: What shows that a table cell's English word was translated.
CELL_HINTS = {
    "algorithmic": ["algorithm", "algorith"], "benefit": ["avantage", "benefice"], "consumer": ["consomm"], "data": ["donnee", "donnees"],
    "faster": ["rapide", "vite"], "higher": ["augmentation", "plus", "hausse", "vente"], "improved": ["ameliore", "securite"],
    "job": ["emploi", "emplois", "travail"], "personalized": ["personnalise"], "privacy": ["confidential", "vie privee"],
    "reduced": ["reduit", "reduits"], "risk": ["risque"], "sales": ["vente", "ventes"],
}


def clean_cell(source, translated) -> Column:
    """Takes English words that the source has off the end of a table cell, never the last one."""
    own = F.transform(find_all(source, "[A-Za-z][A-Za-z-]*"), table_token)

    def cut(s: Column) -> Column:
        words = s["words"]
        keeps = F.transform(F.reverse(words), lambda w: (table_token(w) == "") | among(F.btrim(w, F.lit(L.EDGE_PUNCTUATION)), L.CELL_PROTECTED)
                            | ~F.array_contains(s["own"], table_token(w)) | ~among(table_token(w), L.CELL_RESIDUALS))
        first = F.array_position(keeps, True)
        n = F.least(F.when(first == 0, F.size(words)).otherwise(first - 1), F.size(words) - 1).cast("int")
        left = F.trim(F.rtrim(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - n, F.lit(0))), " "), F.lit(" ,;:-")))
        return F.when((s["text"] == "") | s["text"].startswith("[FR MOCK]") | (n <= 0), s["text"]).otherwise(left)

    text = normalize(translated)
    return let(F.struct(text.alias("text"), words_split(text).alias("words"), own.alias("own")), cut)


def cell_needs_review(source, translated) -> Column:
    text = normalize(translated)
    tokens = find_all(text, r"(?U)\b[A-Za-z][A-Za-z-]*\b")
    odd = F.filter(tokens, lambda x: ~among(F.btrim(x, F.lit(L.EDGE_PUNCTUATION)), L.CELL_PROTECTED) & ~among(table_token(x), L.CELL_ARTICLES))
    french = text.rlike("(?iu)[éèêàùçîôû]") | text.rlike(r"(?iU)\b(de|des|du|la|le|les|un|une|d'|l')\b") | F.exists(tokens, lambda x: among(table_token(x), L.CELL_FRENCH))
    return (
        F.when(text == "", F.trim(col(source)) != "").when(text.startswith("[FR MOCK]"), False)
        .otherwise(((F.size(odd) > 0) & ~french) | F.exists(odd, lambda x: among(table_token(x), L.CELL_RESIDUALS)))
    )


def text_similarity(a, b) -> Column:
    """Ratio of matching blocks of the two texts' repetition keys: 0 if either is empty, 1 if equal.

    The matching-block ratio has no built-in form; batches of the pairs that need it go through Arrow.
    """
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype=float)

    ka, kb = repetition_key(a), repetition_key(b)
    return F.when((ka == "") | (kb == ""), 0.0).when(ka == kb, 1.0).otherwise(ratio(ka, kb))


def list_shape(t) -> Column:
    return col(t).rlike(r"(?U)^\s*([-*•]|\d+[.)]|[A-Za-z][.)])\s+")


def protected_tokens(t) -> Column:
    """Web addresses, bracketed notes, numbers in parentheses and acronyms, in this order, once each."""
    kinds = [r"https?://[^\s)]+", r"\[[0-9A-Za-z]+\]", r"\([0-9]+\)", r"(?U)\b[A-Z]{2,}\b"]
    return F.array_distinct(F.concat(*[find_all(t, k) for k in kinds]))


def preserve_tokens(translated, tokens: Column) -> Column:
    return F.aggregate(tokens, col(translated), lambda a, x: F.when(a.contains(x), a).otherwise(F.trim(F.concat(a, F.lit(" "), x))))


def proper_nouns(t) -> Column:
    """Capitalised phrases, single stop words left out, first seen first, at most twenty."""
    found = find_all(t, r"(?U)\b(?:[A-Z][A-Za-z0-9&.-]+)(?:\s+[A-Z][A-Za-z0-9&.-]+)*\b")
    # Words that start sentences rather than names.
    stop = ["The", "This", "These", "A", "An", "In", "On", "For", "Section", "Article"]
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~among(x, stop))), 1, 20)


def summary(t, most: int = 360) -> Column:
    text = normalize(t)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(most)), " [^ ]*$", ""), F.lit("...")))


#: Words that decide the tone, and its names; audiences of domains.
TONES = [
    (["agreement", "liability", "clause"], "juridique, precis et professionnel"), (["api", "system", "configuration"], "technique, clair et factuel"),
    (["abstract", "methodology", "results"], "academique et formel"),
]
OTHER_TONE = "professionnel, naturel et clair"
AUDIENCES = {
    "legal": "professionnels du droit et parties contractantes", "technical": "equipes techniques et chefs de projet",
    "academic": "lecteurs academiques", "business": "professionnels metier",
}
OTHER_AUDIENCE = "lecteurs professionnels francophones"


def tone(t) -> Column:
    out, low = F.lit(OTHER_TONE), F.lower(col(t))
    for words, name in reversed(TONES):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def audience(domain) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in AUDIENCES.items() for x in kv])[col(domain)], F.lit(OTHER_AUDIENCE))


def error_message(t) -> Column:
    return F.left(F.translate(col(t), "\n\r", "  "), F.lit(500))


def is_rate_limit(t, status) -> Column:
    return (col(status) == 429) | F.lower(col(t)).rlike("429|rate_limit_exceeded")


def line_count(t, width, size) -> Column:
    """Lines that the text needs in the width; 999 where nothing fits."""
    t, width, size = col(t), col(width), col(size)
    per = F.greatest(F.floor(width / (size * 0.52)), F.lit(1))
    return F.when((width <= 0) | (size <= 0), 999).otherwise(F.greatest(F.lit(1), F.ceil(F.length(t) / per))).cast("long")
