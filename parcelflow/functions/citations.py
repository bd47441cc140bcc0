"""Citation labels and lists for retrieval hits."""

from pyspark.sql import Column, functions as F

from .columns import non_empty


def citation_ref(source: Column, chunk_id: Column) -> Column:
    """``source#chunk``; source defaults to ``kb`` and the chunk part is left out if empty."""
    label = F.coalesce(non_empty(source), F.lit("kb"))
    return F.concat(label, F.coalesce(F.concat(F.lit("#"), non_empty(chunk_id)), F.lit("")))


def citation_label(source: Column, chunk_id: Column) -> Column:
    """Reply variant: ``source#chunk``, source only, ``kb#chunk``, or ``kb``."""
    src, chk = non_empty(source), non_empty(chunk_id)
    return F.coalesce(
        F.concat(src, F.lit("#"), chk), src, F.concat(F.lit("kb#"), chk), F.lit("kb")
    )


def citation_list(hits: Column) -> Column:
    """array<struct<ref, score>> in hit order."""
    return F.transform(
        hits,
        lambda h: F.struct(
            citation_ref(h["source"], h["chunk_id"]).alias("ref"), h["score"].alias("score")
        ),
    )


def reply_citations(citations: Column, hits: Column) -> Column:
    """Refs of the citation list; rebuilt from the hits if the list has none."""
    refs = F.filter(citations["ref"], lambda r: F.char_length(r) > 0)
    rebuilt = F.transform(hits, lambda h: citation_label(h["source"], h["chunk_id"]))
    return F.when(F.size(refs) > 0, refs).otherwise(rebuilt)


def hit_fields(
    source: Column, file: Column, chunk_id: Column, point_id: Column, score: Column, kb: bool = True
) -> dict[str, Column]:
    """Source, chunk and score of a stored hit, with fallbacks for missing ones.

    Source falls back to the file, then to ``kb`` (or the empty string); chunk to the point id,
    then to the empty string; score to zero.
    """
    return {
        "source": F.coalesce(non_empty(source), non_empty(file), F.lit("kb" if kb else "")),
        "chunk_id": F.coalesce(
            non_empty(chunk_id.cast("string")), non_empty(point_id.cast("string")), F.lit("")
        ),
        "score": F.coalesce(score.cast("double"), F.lit(0.0)),
    }
