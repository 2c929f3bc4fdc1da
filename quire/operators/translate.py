"""Translation stage: providers as column functions, eligibility, checks of what came back, contexts and prompts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions import text as X
from quire.functions.text import among, col


def mock_translate(source: Column) -> Column:
    """The stand-in provider: a marked copy, through the cleaning that every provider's output passes."""
    return X.clean_artifacts(F.concat(F.lit(L.MOCK_PREFIX), source))


#: name -> translation of a source column.
PROVIDERS: dict[str, Callable[[Column], Column]] = {"mock": mock_translate, "copy": lambda s: s}


def called(client: Callable[[str], str], retries: int = 1, fallback: Callable[[str], str] | None = None, wait: Callable[[int], None] | None = None) -> Callable[[Column], Column]:
    """A provider that calls ``client`` for each text, in Arrow batches: struct(text, code, message) by row.

    Errors are tried again ``retries`` times; one that says 429 stops the trying as ``RATE_LIMITED``; others use
    ``fallback`` where there is one and are ``TRANSLATION_FAILED`` else.
    """
    def one(text: str) -> tuple[str | None, str | None, str | None]:
        for attempt in range(retries + 1):
            try:
                found = parse_reply(client(text))
                if found:
                    return found, None, None
                message = "empty translation"
            except Exception as error:  # any failure of a client becomes the row's error
                message = str(error).replace("\n", " ")[:500]
                if "429" in message or "rate_limit_exceeded" in message.lower():
                    return None, "RATE_LIMITED", message
            if wait and attempt < retries:
                wait(attempt + 1)
        if fallback is not None:
            return fallback(text), None, message
        return None, "TRANSLATION_FAILED", message

    @F.pandas_udf("text string, code string, message string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t or "") for t in texts], columns=["text", "code", "message"])

    return run


def parse_reply(reply: str) -> str:
    """The text of a reply: a JSON object with ``translated_text``, or the reply itself."""
    import json

    bare = (reply or "").strip()
    if bare.startswith("{"):
        return str(json.loads(bare).get("translated_text") or "").strip()
    return bare


def reply_text(reply) -> Column:
    """``parse_reply`` as a column; null where nothing usable came."""
    bare = F.trim(col(reply))
    return F.nullif(F.trim(F.when(bare.startswith("{"), F.get_json_object(bare, "$.translated_text")).otherwise(bare)), F.lit(""))


def should_translate(kind, source, warnings=None) -> Column:
    usable = among(col(kind), L.SCORED_TYPES) & (F.trim(col(source)) != "")
    return usable if warnings is None else usable & ~F.array_contains(col(warnings), "noise_block")


def translation_status(kind, source, translated, mock_allowed: bool = True) -> Column:
    """struct(status, warning) of a block after translation."""
    said = lambda status, warning: F.struct(F.lit(status).alias("status"), F.lit(warning).cast("string").alias("warning"))
    kind = col(kind)
    residual = X.has_residual(translated) | X.too_many_english(translated)
    return (
        F.when(kind == "image", said("skipped", "image_translation_not_supported")).when(kind == "noise", said("needs_review", None))
        .when((kind == "unknown") & (F.trim(col(source)) != ""), said("needs_review", "unsupported_text_fragment"))
        .when(~among(kind, L.SCORED_TYPES), said("pending", None)).when(X.is_suspicious(source, kind), said("needs_review", "suspicious_fragment"))
        .when(F.trim(col(translated)) == "", said("needs_review", "suspicious_translation"))
        .when(F.lit(not mock_allowed) & residual, said("needs_review", "english_residual")).otherwise(said("translated", None))
    )


def document_context(blocks: DataFrame, domain: str = "general") -> DataFrame:
    """One row for each document: summary, tone, audience and proper nouns of its texts in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", X.normalize("source_text").alias("t")))), lambda x: x["t"]), " ")
    whole = blocks.where(should_translate("type", "source_text")).groupBy("doc_id").agg(text.alias("text"))
    return whole.select(
        "doc_id", X.summary("text").alias("summary"), X.tone("text").alias("tone"), X.audience(F.lit(domain)).alias("audience"),
        F.array_join(X.proper_nouns("text"), "; ").alias("proper_nouns"),
    )


def stated(blocks: DataFrame, mock_allowed: bool = True) -> DataFrame:
    """Blocks with ``status``, ``warning`` and ``warnings``.  A generator makes the pair, so that it is worked out once for all its uses."""
    s = translation_status("type", "source_text", "translated_text", mock_allowed)
    return blocks.select("*", F.inline(F.array(s))).withColumn("warnings", F.array_compact(F.array("warning")))


def translate_document(blocks: DataFrame, translate, mock_allowed: bool = True, batch_size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Blocks with translation, status, warning and scores, and the states of their batches.

    ``translate`` turns the source column into the translated one; it sees the texts of eligible blocks only.  A caller
    that writes the blocks before it asks for the batches has every block translated once.
    """
    from quire.operators import batches, quality, sections

    found = F.when(should_translate("type", "source_text"), translate(F.col("source_text"))).otherwise(F.lit(""))
    said = stated(blocks.withColumn("translated_text", F.coalesce(found, F.lit(""))), mock_allowed)
    done = quality.score_blocks(quality.occurrences(sections.section_lookup(said.drop("warnings"))))
    return done, batches.batch_status(said, batch_size)


def user_prompt(context: DataFrame, blocks: DataFrame) -> DataFrame:
    """The request text of each eligible block: its document's context, then its source."""
    joined = blocks.where(should_translate("type", "source_text")).join(context, "doc_id")
    label = lambda name, value: F.concat(F.lit(f"{name}: "), F.when(value == "", "none").otherwise(value))
    return joined.select("doc_id", "pos", F.concat_ws(
        "\n", label("Summary", F.col("summary")), label("Tone", F.col("tone")), label("Audience", F.col("audience")),
        label("Names", F.col("proper_nouns")), label("Text", F.col("source_text")),
    ).alias("prompt"))


def glossary_terms(glossary: Column) -> Column:
    """Trimmed terms with both sides; ``required`` false where absent."""
    clean = F.transform(glossary, lambda g: F.struct(F.trim(g["source"]).alias("source"), F.trim(g["target"]).alias("target"), F.coalesce(g["required"], F.lit(False)).alias("required")))
    return F.filter(clean, lambda g: (g["source"] != "") & (g["target"] != ""))
