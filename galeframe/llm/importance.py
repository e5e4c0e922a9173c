"""Importance resampling of documents towards a target text collection.

Features are single words and pairs of neighbouring words, hashed into buckets.  A block
of texts is joined with a separator byte into one buffer; one pass of a regular expression
finds all words of the block, a binary search in the texts' offsets tells whose they are,
and pairs whose words belong to two texts are masked before buckets are counted.

Bucket counts of the corpus and of the target give every bucket a gain; a text's weight is
the mean gain of its features, and a Gumbel variable drawn from a hash of its id is added,
so that the highest scores are a sample without replacement in proportion to the weights.
The features of a text are written once, two bytes each, and read by both passes.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.support import kept, mapped
from galeframe.llm.words import distinct

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
# Bytes of text joined at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

# Words as bytes of UTF-8 with A-Z lower-cased (fixed): digits, letters, all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\x00"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of all texts end to end, and of each text how many features
    and words it has."""
    joined = SEPARATOR.join(texts).translate(LOWER)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    spans = np.fromiter(chain.from_iterable(m.span() for m in WORD.finditer(joined)), np.int64)
    begin, end = spans[::2], spans[1::2]
    owner = np.searchsorted(offsets, begin, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    if not len(begin):
        return np.zeros(0, np.int64), n_words, n_words
    first, kind = distinct(np.frombuffer(joined, np.uint8), begin, end)
    found = [joined[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
    crc = [zlib.crc32(w) for w in found]
    inner = np.flatnonzero(owner[1:] == owner[:-1])  # pairs within one text
    pairs, which = np.unique(kind[inner] * len(found) + kind[inner + 1], return_inverse=True)
    behind = [b" " + w for w in found]
    left, right = (x.tolist() for x in divmod(pairs, len(found)))
    pair_crc = np.fromiter((zlib.crc32(behind[b], crc[a]) for a, b in zip(left, right)), np.int64, len(pairs))
    own = np.concatenate([np.array(crc, np.int64)[kind], pair_crc[which]]) % buckets
    row = np.concatenate([owner, owner[inner]])
    order = np.argsort(row, kind="stable")
    return own[order], np.bincount(row, minlength=len(texts)), n_words


def _blocks(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in column.cast(pa.large_binary()):
        text = text.as_py() or b""
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def hashed(docs: DataFrame, id_column: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets): the bucket of every feature, two bytes each.

    Null and empty texts and texts without words have none.
    """
    if buckets > 1 << 16:
        raise ValueError("at most 65,536 buckets")

    def step(batch: pa.RecordBatch) -> dict:
        counts, words, data = [], [], []
        for texts in _blocks(batch.column(1)):
            own, n, w = features(texts, buckets)
            ends = np.cumsum(n)
            own = own.astype("<u2")
            data += [own[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist())]
            counts.append(n)
            words.append(w)
        return {"id": batch.column(0), "n_words": np.concatenate(words), "n_features": np.concatenate(counts), "buckets": pa.array(data, pa.binary())}

    own = docs.select(F.col(id_column).cast("long").alias("id"), "text")
    return mapped(own, step, "id long, n_words long, n_features long, buckets binary")


def counts(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often every bucket occurs in ``hashed`` texts: one array to a task, one row to
    a bucket that the tasks' rows are added up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                total += np.bincount(np.frombuffer(batch.column(0)[k].as_buffer(), "<u2"), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": held.astype(np.int32), "n": total[held]})

    found = table.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # one row to a bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of every bucket, with one
    added to each count."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in pairs], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """A Gumbel variable in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(table: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of ``hashed`` texts.

    Without features the weight is 0; without id there is no score.
    """
    shared = table.sparkSession.sparkContext.broadcast(gain)

    def step(batch: pa.RecordBatch) -> dict:
        value = shared.value
        n = batch.column(2).to_numpy()
        total = np.array([value[np.frombuffer(b.as_buffer(), "<u2")].sum() for b in batch.column(3)], np.int64)
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        score = [None if i is None else w + noise(i, seed) for i, w in zip(batch.column(0).to_pylist(), weight.tolist())]
        return {"doc_id": batch.column(0), "n_words": batch.column(1), "n_features": batch.column(2), "weight": weight, "score": pa.array(score, pa.int64())}

    return mapped(table, step, "doc_id long, n_words long, n_features long, weight long, score long")


def ranks(found: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` rows with the rank of those that are drawn, 1 for the highest score.

    Rows of fewer words and rows without id are never drawn and not counted.  A score is a
    whole number of some ten thousand possible ones, so their histogram tells which scores
    are drawn and how many rows stand above each; rows of one score are ranked by id.
    Repeated rows take ranks one after the other.
    """
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    # One row to a score that occurs: bounded by the range of scores, not by the rows.
    histogram = sorted(((r[0], r[1]) for r in found.where(able).groupBy("score").count().collect()), reverse=True)
    drawn = percent * sum(n for _, n in histogram) // 100
    above, steps = 0, []
    for score, n in histogram:
        if above >= drawn:
            break
        steps.append((score, above))
        above += n
    none = F.lit(None).cast("long")
    if not steps:
        return found.withColumn("rank", none)
    high = able & (F.col("score") >= steps[-1][0])
    offsets = found.sparkSession.createDataFrame(steps, "score long, above long")
    own = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    top = found.where(high).join(F.broadcast(offsets), "score").withColumn("rank", F.col("above") + own)
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*found.columns, "rank")
    return top.unionByName(found.where(~F.coalesce(high, F.lit(False))).withColumn("rank", none))


def resampled(docs: DataFrame, target: DataFrame, target_id: str = "item_id", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; rank is null
    where a row is not drawn.

    Null and empty texts have no features, weight 0, and are never drawn; rows without id
    have neither score nor rank; repeated rows are drawn each for itself.  An empty table
    gives no rows; with an empty target every gain is by the corpus alone.  Other columns
    are not read.
    """
    table = kept(hashed(docs, "doc_id"), "features")
    gain = gains(counts(table), counts(hashed(target, target_id)))
    found = kept(scored(table, gain, seed), "scores")
    return ranks(found, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are drawn, all columns kept; a repeated id that is drawn more
    than once stays as often as it stands in ``docs``."""
    chosen = resampled(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_gf_drawn")).distinct()
    return docs.join(chosen, docs["doc_id"].cast("long") == chosen["_gf_drawn"], "left_semi")


# The same rows in DuckDB; the table of the checksum is built from its polynomial.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"""
SQL = f"""
WITH RECURSIVE crc(i, c, k) AS (
    SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
  tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
  d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  f AS (SELECT 1 AS own, doc_id AS id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS g FROM d
        UNION ALL SELECT 0, item_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) FROM b),
  u AS (SELECT DISTINCT g, hex(g) AS x FROM f),
  v AS (SELECT g, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
            [CAST(16 * (strpos('0123456789ABCDEF', x[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i]) - 1 AS BIGINT) for i in range(1, len(x) // 2 + 1)]),
            lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS BIGINT) + 1])) AS c FROM u, tab),
  h AS (SELECT g, xor(c, 4294967295) % 10000 AS bucket FROM v),
  n AS (SELECT bucket, sum(own) AS s, sum(1 - own) AS t FROM f JOIN h USING (g) GROUP BY bucket),
  a AS (SELECT sum(own) AS s_all, sum(1 - own) AS t_all FROM f),
  gain AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS gain FROM n, a),
  m AS (SELECT id, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM f JOIN h USING (g) JOIN gain USING (bucket) WHERE own = 1 GROUP BY id),
  r AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
          CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m ON m.id = d.doc_id),
  z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
  y AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS most FROM z WHERE n_words >= 20)
SELECT z.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank
FROM z LEFT JOIN y USING (doc_id)
"""
