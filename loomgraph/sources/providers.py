"""Contracts of sources behind a service: what callers may rely on, whatever answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.items import provider_answers

# Languages of captions, the wanted ones first.
CAPTION_LANGUAGES = ("hi", "ur", "en")


def best_caption(captions: list[dict], languages: tuple[str, ...] = CAPTION_LANGUAGES) -> dict | None:
    """Captions made by people before generated ones, then by language; none in another language."""
    some = [c for c in captions if c.get("language_code") in languages and c.get("text")]
    return min(some, key=lambda c: (bool(c.get("is_generated")), languages.index(c["language_code"])), default=None)


def transcripts(videos: DataFrame, fetch: Callable[[str], list[dict]]) -> DataFrame:
    """video_id, text, language_code, is_generated, reason: one row a video.

    ``fetch`` gives a video's captions.  It may fail: a video without a transcript has nulls and a
    ``reason`` (no_transcript, or the error's name), and never stops the others.
    """

    def one(row: dict) -> list[dict]:
        out = {"video_id": row["video_id"], "text": None, "language_code": None, "is_generated": None, "reason": None}
        try:
            found = best_caption(fetch(row["video_id"]))
        except LookupError:
            found = None
        except Exception as e:  # the contract: a provider never raises
            return [out | {"reason": type(e).__name__}]
        if found is None:
            return [out | {"reason": "no_transcript"}]
        return [out | {"text": found["text"], "language_code": found["language_code"], "is_generated": bool(found.get("is_generated"))}]

    return provider_answers(videos.select("video_id"), "video_id string, text string, language_code string, is_generated boolean, reason string", one)


def batches(found: DataFrame, size: int) -> DataFrame:
    """(id, batch): ids in the order in which queries first gave them, ``size`` to a request.

    ``found``: query, place, id.  Batches are numbered within one request list, so the ids of one run are in one window.
    """
    first = found.groupBy("id").agg(F.min(F.struct("query", "place")).alias("at"))
    number = F.row_number().over(Window.orderBy("at")) - 1
    return first.withColumn("batch", F.floor(number / size)).select("id", "batch")
