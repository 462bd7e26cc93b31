"""Texts to words, in Python workers."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

INVISIBLE = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad]")
TAG = re.compile("<[^<>]*>")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower-case NFKC text without invisible characters, tags and line-end hyphens."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = TAG.sub(" ", text)
    if "-\n" in text:
        text = text.replace("-\n", "")
    return text.lower()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the plain text; none for null and empty texts."""
    return WORD.findall(plain(text)) if text else []


class Encoded:
    """The words of some texts as codes of one dictionary: flat codes, the texts' offsets, the words, their hashes."""

    def __init__(self, texts: list[list[str]]):
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        flat = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
        self.codes, self.vocabulary = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a small input lies in fewer splits; the rows stay the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
