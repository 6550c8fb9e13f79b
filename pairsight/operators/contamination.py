"""Verbatim containment of sentences in passages, without a loop over pairs.

A sentence of k words can stand only where its first words do: sentences are keyed by the
hash of their first ``lead`` words, passages give the hash of each run of that many words,
and only pairs that meet are held against each other. Exact, for sentences that start and
end at word boundaries or not: both are cut at white space, and sentences with fewer words
are met by their own number of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAD = 4


def contained(passages: DataFrame, sentences: DataFrame, passage_id: str, passage: str, sentence_id: str, sentence: str, lead: int = LEAD) -> DataFrame:
    """passage_id, sentence_id of each verbatim containment.

    The words after the first are whole words in any passage that contains the sentence;
    so the key is made of the words from the second on, which spares partial first and last words.
    """
    words = F.split(F.col(sentence), " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    key = F.least(F.size(inner), F.lit(lead))
    keyed = sentences.select(F.col(sentence_id), F.col(sentence).alias("_s"), key.alias("_n"), inner.alias("_w"))
    lengths = sorted(r[0] for r in keyed.select("_n").distinct().collect())  # at most lead + 1 values
    out = None
    for n in lengths:
        some = keyed.where(F.col("_n") == n).withColumn("_h", F.xxhash64(*(F.get("_w", F.lit(k)) for k in range(n))) if n else F.lit(0)).drop("_w")
        if n == 0:
            met = passages.select(passage_id, F.col(passage).alias("_p")).join(some, F.col("_p").contains(F.col("_s")))
        else:
            runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_t") - n), lambda i: F.xxhash64(*(F.get("_t", i + k) for k in range(n)))))
            split = passages.select(passage_id, F.split(F.col(passage), " ").alias("_t"))  # a column of its own: in the function it would be split anew for each word
            spread = split.where(F.size("_t") >= n).select(passage_id, F.explode(runs).alias("_h")).join(some.select(sentence_id, "_h"), "_h")
            met = spread.select(passage_id, sentence_id).join(passages.select(passage_id, F.col(passage).alias("_p")), passage_id).join(some.select(sentence_id, "_s"), sentence_id).where(F.col("_p").contains(F.col("_s")))
        met = met.select(passage_id, sentence_id).distinct()
        out = met if out is None else out.union(met)
    return out
