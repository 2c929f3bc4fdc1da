"""Block scores between 0 and 1, as expressions over the columns of a block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions import text as X
from quire.functions.text import among, col


def clamp(x: Column) -> Column:
    return F.round(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)), 3)


def parse(name: str) -> Column:
    """Score in a text or number column; null where it is none."""
    return clamp(F.expr(f"try_cast(`{name}` AS DOUBLE)"))


def less(condition: Column, points: float) -> Column:
    return F.when(condition, -points).otherwise(0.0)


def more(condition: Column, points: float) -> Column:
    return F.when(condition, points).otherwise(0.0)


@dataclass(frozen=True)
class Texts:
    """What several scores need of a block's texts; as columns of their own they are worked out once."""

    s: Column  # normal source
    t: Column  # normal translation
    s_words: Column
    t_words: Column
    s_ascii: Column  # ASCII words of the source
    t_tokens: Column  # ASCII tokens of the translation

    @classmethod
    def of(cls, source, translated) -> Texts:
        s, t = X.normalize(source), X.normalize(translated)
        return cls(s, t, X.word_count(s), X.word_count(t), X.ascii_words(s), X.ascii_tokens(t))

    @classmethod
    def prepared(cls, df: DataFrame, source: str, translated: str) -> tuple[DataFrame, Texts]:
        """``df`` with the columns ``__s`` and so on, in two steps, and the record that names them."""
        df = df.withColumns({"__s": X.normalize(source), "__t": X.normalize(translated)})
        s, t = F.col("__s"), F.col("__t")
        made = {"__s_words": X.word_count(s), "__t_words": X.word_count(t), "__s_ascii": X.ascii_words(s), "__t_tokens": X.ascii_tokens(t)}
        return df.withColumns(made), cls(s, t, *[F.col(c) for c in made])


def is_scored(kind) -> Column:
    return among(col(kind), L.SCORED_TYPES)


def is_garbled(t: Column) -> Column:
    marks = F.length(F.regexp_replace(t, r"[^#@$%^*_+=<>|~]", ""))
    return t.rlike(r"(.)\1{5,}") | (marks >= 3)


def translation_quality(kind, x: Texts, mock_allowed: bool = True) -> Column:
    kind, s, t, words = col(kind), x.s, x.t, x.t_words
    ratio = words / F.greatest(x.s_words, F.lit(1))
    unfinished = among(kind, ["paragraph", "footnote"]) & (words >= 6) & ~t.rlike("[.!?]$")
    brackets = F.length(F.regexp_replace(t, r"[^\[]", "")) != F.length(F.regexp_replace(t, r"[^\]]", ""))
    score = (
        F.lit(1.0) + less((words < 2) & ~among(kind, ["title", "caption"]), 0.35) + less((ratio < 0.35) | (ratio > 2.4), 0.25) + less(is_garbled(t), 0.35)
        + less(F.lit(not mock_allowed) & t.contains("[FR MOCK]"), 0.5) + less(unfinished, 0.1) + less(brackets, 0.1)
    )
    return F.when(~is_scored(kind) | (s == "") | (t == ""), 0.0).otherwise(clamp(score))


def english_residual(kind, x: Texts) -> Column:
    tokens = x.t_tokens
    exempt = lambda x: among(x, L.SCORING_ACRONYMS) | x.startswith("http") | x.startswith("www") | (X.is_upper(x) & (F.length(x) > 1)) | (X.starts_upper(x) & (F.length(x) > 2))
    open_tokens = F.filter(tokens, lambda x: ~exempt(x))
    count = lambda words: F.size(F.filter(open_tokens, lambda x: among(X.token_form(x), words)))
    score = F.least(F.lit(0.85), count(L.SCORING_RESIDUALS) / F.greatest(F.size(tokens), F.lit(1)) * 2.4) + F.least(F.lit(0.25), count(L.MINI_SPAN_WORDS) * 0.08)
    return F.when(~is_scored(kind) | (F.size(tokens) == 0), 0.0).otherwise(clamp(score))


def token_overlap(a, b) -> Column:
    x, y = (F.array_distinct(X.find_all(F.lower(col(t)), "[a-z]+")) for t in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def semantic_consistency(kind, x: Texts, section_title) -> Column:
    kind, s, t, title = col(kind), x.s, x.t, X.normalize(section_title)
    ratio = x.t_words / F.greatest(x.s_words, F.lit(1))
    few = F.size(X.find_all(F.lower(s), "[a-z]+")).between(1, 2)
    score = (
        F.lit(0.82) + F.when(ratio.between(0.55, 1.9), 0.12).otherwise(-0.18) + more((title != "") & (kind == "title") & (token_overlap(s, title) >= 0.4), 0.06)
        + less((kind == "list_item") & ~X.list_shape(s), 0.08) + less(few, 0.45)
    )
    return F.when(~is_scored(kind) | (s == "") | (t == ""), 0.0).otherwise(clamp(score))


def is_plausible_title(words: Column) -> Column:
    return F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike("^[A-Z]") | among(F.lower(w), L.SEMANTIC_STOPWORDS))


def has_sentence_shape(t: Column, words: Column) -> Column:
    n = F.size(words)
    return (n >= 8) | ((n >= 4) & t.rlike("[.!?:;]$"))


def semantic_confidence(kind, x: Texts, size, section_title, occurrences, noise: Column, merged: Column, contained: Column | None = None) -> Column:
    """struct(score, category): early verdicts first, then points."""
    kind, s, t, n, words = col(kind), x.s, x.t, F.size(x.s_ascii), x.s_words
    plausible, shape = is_plausible_title(x.s_ascii), has_sentence_shape(s, x.s_ascii)
    signal = F.coalesce(token_overlap(s, F.nullif(col(section_title), F.lit(""))) >= 0.15, F.lit(False))
    mini = F.when(n == 0, True).when((kind == "title") & plausible, False).otherwise((n <= 1) | ((n <= 3) & ~shape))
    weak = ~((kind == "title") & plausible) & (words <= 3) & ~s.rlike("[.!?:;]$")
    title = F.lit(0.08) + more(col(size) >= 13, 0.18) + more(words.between(2, 8) & plausible, 0.08)
    score = clamp(
        F.lit(0.52) + F.when(n >= 6, 0.22).when(n >= 4, 0.12).otherwise(0.0) + more(shape, 0.16) + more(t != "", 0.05)
        + F.when(kind == "title", title).otherwise(0.0) + more((kind == "list_item") & X.list_shape(s), 0.08) + less(t.contains(s) & (t != s), 0.05)
        + less(weak, 0.18) + more(merged, 0.08) + more(signal, 0.08)
    )
    category = (
        F.when(score >= 0.75, "strong_document_block").when(score < 0.35, "semantic_noise").when(score < 0.55, "probable_fragment")
        .when(merged, "merged_fragment").otherwise("strong_document_block")
    )
    verdict = lambda v, c: F.struct(F.lit(v).alias("score"), F.lit(c).alias("category"))
    acronym = s.rlike("^[A-Z][A-Z0-9.-]+$")
    return (
        F.when(~is_scored(kind) | (s == ""), verdict(0.0, "semantic_noise")).when(noise, verdict(0.05, "semantic_noise"))
        .when((col(occurrences) > 1) & (words <= 4), verdict(0.2, "semantic_noise"))
        .when(F.lit(False) if contained is None else contained, verdict(0.25, "merged_fragment"))
        .when(acronym & signal, verdict(0.5, "contextual_acronym")).when(acronym, verdict(0.2, "probable_fragment"))
        .when(mini, verdict(0.25, "probable_fragment")).otherwise(F.struct(score.alias("score"), category.alias("category")))
    )


def overlay_risk(kind, x: Texts, x0, y0, x1, y1, size, overflow: Column | None = None) -> Column:
    s, t, size = x.s, x.t, F.when(col(size) > 0, col(size)).otherwise(10.0)
    w, h = F.greatest(col(x1) - col(x0), F.lit(0.0)), F.greatest(col(y1) - col(y0), F.lit(0.0))
    ratio = F.length(t) / F.greatest(F.length(s), F.lit(1))
    risk = (
        more(w < F.greatest(F.lit(80.0), size * 8), 0.25) + more(h < F.greatest(F.lit(12.0), size * 1.25), 0.2)
        + F.when(ratio > 1.45, F.least(F.lit(0.35), (ratio - 1.45) * 0.22)).otherwise(0.0)
        + more(X.line_count(t, w, size) * size * 1.2 > h, 0.25) + more(F.lit(False) if overflow is None else overflow, 0.35)
    )
    return F.when(~is_scored(kind) | (t == ""), 0.0).otherwise(clamp(risk))


def managed_warnings(warnings: Column, tq: Column, sc: Column, risk: Column, residual: Column, confidence: Column, category: Column) -> Column:
    """The block's warnings with the scoring ones set anew."""
    old = F.array_except(warnings, F.array(*[F.lit(w) for w in [*L.QUALITY_WARNINGS, "semantic_noise", "probable_fragment"]]))
    low = F.when(category == "semantic_noise", "semantic_noise").when(category == "probable_fragment", "probable_fragment").when(confidence < 0.45, "low_semantic_confidence")
    new = F.array(
        F.when(tq < 0.55, "low_translation_quality"), F.when(sc < 0.55, "low_semantic_consistency"), F.when(risk > 0.55, "high_overlay_risk"),
        F.when(residual > 0.25, "english_residual_detected"), low,
    )
    return F.array_compact(F.concat(old, new))
