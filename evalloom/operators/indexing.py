"""A corpus as a collection of points: documents to chunks, to vectors, to rows with ids that are the same whenever they are made again."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.operators import passages
from evalloom.operators import prompting as P
from evalloom.operators.collections import Collections
from evalloom.operators.offline import DIMS, with_term_vectors
from evalloom.sources.scratch import written

#: Texts that an embedding service takes in one call.
BATCH = 16


def chunking_hash(strategy: str = "headings", size: int = 500, overlap: int = 50, least: int = 80) -> str:
    """The fingerprint of a chunking, which names its collections."""
    settings = {"strategy": strategy, "chunk_size": size, "overlap": overlap, "min_chars": least}
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def index_corpus(collections: Collections, corpus: int, docs: DataFrame, namespace: str, strategy: str = "headings", size: int = 500, overlap: int = 50, least: int = 80, dims: int = DIMS, recreate: bool = False, embed=None) -> tuple[str, DataFrame]:
    """Indexes documents (doc, text); gives the collection's name and a row on it: docs, chunks, points, calls, chars.

    ``embed`` takes (chunks, id, text, into, dims) and gives ids and vectors; without it a chunk's words are counted where it is. Indexing
    again changes nothing: points have the same ids, and a point that comes again replaces the stored one. Chunks and vectors are made once."""
    named = chunking_hash(strategy, size, overlap, least)
    name = f"corpus{corpus}_{named[:8]}"
    chunks = passages.chunk_rows(docs.select("doc", "text"), "text", strategy, size, overlap, least)
    points = P.index_points(chunks, corpus, named, namespace)
    if embed:
        chunks = written(points, "chunks")
        points = chunks.join(embed(chunks, "point_id", "text", "embedding", dims), "point_id")
    else:
        points = with_term_vectors(points, "text", "embedding", dims).where("embedding is not null")
    points = written(points, "points")
    collections.ensure(name, dims, recreate)
    collections.upsert(name, points)
    return name, P.index_report(docs, points, BATCH).withColumn("collection", F.lit(name))
