"""Exact Jaccard join of texts as sets of word n-grams, by partitions of the universe.

Two sets with similarity of at least 3/4 differ in at most (|x| + |y|) / 7 elements.  The
universe of n-grams is cut by hash into segments, more of them than that number, so the
two sets agree on a whole segment.  Sizes are dealt into bands of ratio 4/3; a set is
indexed under the segments of its own band and looks for smaller or equal partners in
its own band and the next lower one.

A set need not look under all its segments: any choice whose number exceeds the possible
differences finds every partner.  It takes those that cost least, which are the segments
with most n-grams that are rare in a sample.  Small sets have few segments to choose
from; there a segment also has its one-deletion neighbourhood as keys, so that it stands
for two differences, and fewer, larger segments do.

Keys are dealt over tasks by hash.  Sets that meet under a key are candidates and are
verified exactly, in two steps that keep large groups linear: first every set of a key
against the most typical of them; then, where sets of a key are still in different
components, the pairs across them that can be linked at all.  Two bounds tell which:
n-grams that only one candidate has are shared with none; and two sets tested against the
same third one (their home) share no more of its n-grams than either does, so that the
others must make up for the rest, and pairs are looked up by those.  Equal sets are one
set from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.components import components
from galeframe.llm.ranks import mixed, ragged
from galeframe.llm.support import kept, mapped, tasks, utf8
from galeframe.llm.words import _runs, doc_blocks, word_hashes

WORDS = 5
# Sets below this size use one-deletion neighbourhoods.
SMALL = 27
# Share of segments beyond the necessary number, to choose from.
SPARE = 0.15
# Texts of the sample from which common n-grams are known, and how many must hold one.
SAMPLE, COMMON = 2000, 10
# Sets and keys that travel together; the place of a set has 14 bits beside a key.
MOST_ROWS, MOST_KEYS = 1 << 14, 1 << 19

_INDEX, _PROBE = 1, 2
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(text: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word n-grams of every text, ascending, and how many each has.

    Words are what stands between spaces and U+0009 to U+000D, A-Z lower-cased; a text
    with fewer words has one n-gram of all of them, one without words none.
    """
    text = text.copy()
    text[(text >= 65) & (text <= 90)] += 32
    begin, end = _runs((text != 32) & ((text < 9) | (text > 13)), offsets[:-1][offsets[:-1] < len(text)])
    rows = len(offsets) - 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    word = word_hashes(text, begin, end)
    owner = np.searchsorted(offsets, begin, "right") - 1
    per_row = np.bincount(owner, minlength=rows)
    first = np.cumsum(per_row) - per_row
    grams = np.where(per_row > 0, np.maximum(1, per_row - words + 1), 0)
    at = ragged(first, grams)
    row = np.repeat(np.arange(rows), grams)
    left = np.minimum(per_row[row], words)
    total = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = k < left
        total = total * _MIX[0] + np.where(inside, word[np.minimum(at + k, len(word) - 1)], np.uint64(k + 1))
    total = mixed(total)
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    fresh = np.r_[True, (total[1:] != total[:-1]) | (row[1:] != row[:-1])]
    return total[fresh], np.bincount(row[fresh], minlength=rows)


def _bounds(most: int = 1 << 40) -> np.ndarray:
    """First size of every band."""
    out = [1]
    while out[-1] < most:
        out.append(-(-4 * out[-1] // 3))
    return np.array(out, np.int64)


BANDS = _bounds()


def _segments(band: np.ndarray) -> np.ndarray:
    """Segments of a band: enough for the largest set in it and a partner 4/3 as large."""
    least = (BANDS[band + 1] - 1) // 3 + 1
    small = BANDS[band] < SMALL
    return np.where(small, least // 2 + 1, (least * (1 + SPARE)).astype(np.int64) + 1)


def _key(total: np.ndarray, segment: np.ndarray, band: np.ndarray) -> np.ndarray:
    return mixed(total + segment.astype(np.uint64) * _MIX[1] + (band.astype(np.uint64) + np.uint64(1)) * _MIX[2])


def _segment_of(grams: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Ascending with the hash, so that sorted sets are sorted by segment."""
    return (((grams >> np.uint64(32)) * segments.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _large(grams, light, sizes, band, wanted, both: bool):
    """(row, key, roles) of sets under the segments of ``band``; ``wanted`` of each are
    looked under.  With ``both`` all segments are indexed as well."""
    rows = len(sizes)
    count = _segments(band)
    base = np.cumsum(count) - count
    row = np.repeat(np.arange(rows), sizes)
    slot = base[row] + _segment_of(grams, count[row])
    total = np.zeros(int(count.sum()), np.uint64)
    start = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    total[slot[start]] = np.add.reduceat(mixed(grams), start)
    weight = np.bincount(slot, light + 1e-3, len(total))
    owner = np.repeat(np.arange(rows), count)
    segment = np.arange(len(total)) - base[owner]
    order = np.lexsort((segment, -weight, owner))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    probe = place - base[owner] < wanted[owner]
    key = _key(total, segment, band[owner])
    if both:
        return owner, key, np.where(probe, _INDEX | _PROBE, _INDEX)
    return owner[probe], key[probe], np.full(int(probe.sum()), _PROBE)


def _small(grams: np.ndarray, band: int, needed: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and roles of one small set: every segment with its one-deletion neighbours.

    A segment of two or more n-grams stands for two differences and a single one for one;
    only if that does not cover ``needed`` are the empty neighbours looked under.
    """
    count = int(_segments(np.array([band]))[0])
    segment = _segment_of(grams, np.full(len(grams), count))
    value = mixed(grams)
    totals, segments, weak = [], [], []
    covered = 0
    for s in range(count):
        mine = value[segment == s]
        whole = mine.sum(dtype=np.uint64)
        totals += [whole, *(whole - mine)]
        segments += [s] * (1 + len(mine))
        covered += min(2, len(mine))
        weak += [len(mine) == 0] + [len(mine) == 1] * len(mine)
    key = _key(np.array(totals, np.uint64), np.array(segments), np.full(len(totals), band))
    probe = ~np.array(weak) | (covered < needed)
    if needed < 2:  # only equal sets, which are one set already
        probe[:] = False
    role = np.where(probe, _PROBE, 0) | (_INDEX if both else 0)
    held = role > 0
    return key[held], role[held]


def keys(grams: np.ndarray, sizes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, roles) of sets given end to end: where each is indexed and looks."""
    out = []
    first = np.cumsum(sizes) - sizes
    band = np.searchsorted(BANDS, sizes, "right") - 1
    near = np.searchsorted(common, grams)
    light = np.ones(len(grams))
    if len(common):
        light[common[np.minimum(near, len(common) - 1)] == grams] = 0
    own = 2 * sizes // 7 + 1
    lower = (sizes + BANDS[np.maximum(band, 0)] - 1) // 7 + 1
    for which, of, wanted, both in (
        (sizes >= SMALL, band, own, True),
        ((sizes >= SMALL) & (BANDS[np.maximum(band - 1, 0)] >= SMALL), band - 1, lower, False),
    ):
        some = np.flatnonzero(which)
        if len(some):
            at = ragged(first[some], sizes[some])
            row, key, role = _large(grams[at], light[at], sizes[some], of[some], wanted[some], both)
            out.append((some[row], key, role))
    for k in np.flatnonzero((sizes > 0) & (BANDS[np.maximum(band - 1, 0)] < SMALL)).tolist():
        mine = grams[first[k] : first[k] + sizes[k]]
        if sizes[k] < SMALL:
            key, role = _small(mine, int(band[k]), int(own[k]), True)
            out.append((np.full(len(key), k), key, role))
        if band[k] > 0:
            key, role = _small(mine, int(band[k]) - 1, int(lower[k]), False)
            out.append((np.full(len(key), k), key, role))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _set_hash(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every set (0 for the empty one)."""
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        first = (np.cumsum(sizes) - sizes)[some]
        out[some] = mixed(np.add.reduceat(mixed(grams ^ _MIX[2]), first) + sizes[some].astype(np.uint64))
    return out


def _set_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, n-grams, sizes) of blocks of about BLOCK_BYTES of text."""
    text, offsets = utf8(column)
    for a, b in doc_blocks(offsets):
        yield a, b, *shingles(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _set_id(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The name of every set, 63 bits of its hash (0 for the empty one)."""
    return (_set_hash(grams, sizes) >> np.uint64(1)).view(np.int64)


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, rep): the set of every row is named by ``rep``."""

    def step(batch: pa.RecordBatch) -> dict:
        found = [(sizes, _set_id(grams, sizes)) for _, _, grams, sizes in _set_blocks(batch.column(1))]
        sizes, rep = (np.concatenate(c) for c in zip(*found))
        return {"doc_id": batch.column(0), "text_key": batch.column(2), "n_shingles": sizes, "rep": rep}

    return mapped(docs, step, "doc_id long, text_key long, n_shingles long, rep long")


def _common(docs: DataFrame, rows: int) -> np.ndarray:
    """N-grams that many texts of a bounded sample hold."""
    spread = 1_000_000
    share = int(spread * min(1.0, SAMPLE / max(1, rows)))

    def step(batch: pa.RecordBatch) -> dict:
        return {"gram": np.concatenate([grams for _, _, grams, _ in _set_blocks(batch.column(1))]).view(np.int64)}

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(spread)) < share)
    found = mapped(chosen, step, "gram long").groupBy("gram").count().where(F.col("count") >= COMMON).select("gram")
    return np.sort(found.toArrow().column(0).to_numpy().view(np.uint64))


def _packed(held: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    """Keys of many texts as one row to a bucket: the names of the sets that have keys in
    it, and the keys, each with the place of its set's name in that list."""
    rep, key, role = (np.concatenate(c) for c in zip(*held))
    bucket = ((key >> np.uint64(48)).astype(np.int64) % buckets).astype(np.int32)
    order = np.lexsort((rep, bucket))
    rep, key, role, bucket = rep[order], key[order], role[order], bucket[order]
    head = np.r_[True, bucket[1:] != bucket[:-1]]
    other = head | np.r_[True, rep[1:] != rep[:-1]]  # another set than the row before
    cut = np.flatnonzero(head)
    number = np.cumsum(other) - 1
    place = number - number[cut][np.cumsum(head) - 1]
    packed = (key << np.uint64(16) | (place << 2 | role).astype(np.uint64)).astype("<u8")
    names, name_cut = rep[other].astype("<i8"), np.append(number[cut], number[-1] + 1)
    ends = np.append(cut[1:], len(bucket))
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(bucket[cut], pa.int32()),
            "names": pa.array([names[a:b].tobytes() for a, b in zip(name_cut[:-1], name_cut[1:])], pa.binary()),
            "keys": pa.array([packed[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        }
    )


def _meetings(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(meeting, rep, probe): the sets that share a key, where one of them looks.

    The keys of a task's texts travel as one array per bucket, eight bytes a key and eight
    for each set that has keys in the bucket, so what travels for a text does not depend
    on the number of buckets.  Equal sets of a block travel once.  A task sorts what it
    received by bucket and holds one bucket at a time.  Keys that the same sets share
    count as one meeting.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common)
    buckets = min(1 << 16, 8 * tasks(spark))

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            for _, _, grams, sizes in _set_blocks(batch.column(1)):
                rep = _set_id(grams, sizes)
                _, once = np.unique(rep, return_index=True)
                keep = np.zeros(len(sizes), bool)
                keep[once] = True
                keep &= sizes > 0
                row, key, role = keys(grams[np.repeat(keep, sizes)], np.where(keep, sizes, 0), shared.value)
                if held and (rows + len(once) > MOST_ROWS or size + len(key) > MOST_KEYS):
                    yield _packed(held, buckets)
                    held, rows, size = [], 0, 0
                for a in range(0, len(once), MOST_ROWS):  # rows of one block are few, but for empty texts
                    part = np.isin(row, once[a : a + MOST_ROWS])
                    if a and held:
                        yield _packed(held, buckets)
                        held, rows, size = [], 0, 0
                    if part.any():
                        held.append((rep[row[part]], key[part], role[part]))
                        rows, size = rows + min(MOST_ROWS, len(once) - a), size + int(part.sum())
        if held:
            yield _packed(held, buckets)

    def meet_one(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        packed, rep = (np.concatenate(c) for c in zip(*parts))
        key = packed >> np.uint64(16)
        order = np.lexsort((rep, key))
        key, rep, packed = key[order], rep[order], packed[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])]
        key, rep, probe = key[fresh], rep[fresh], (packed[fresh] & np.uint64(_PROBE)) > 0
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.append(cut, len(key)))
        use = (size > 1) & (np.add.reduceat(probe, cut, dtype=np.int64) > 0)
        cut, size = cut[use], size[use]
        if not len(cut):
            return None
        at = ragged(cut, size)
        rep, probe = rep[at], probe[at]
        cut = np.cumsum(size) - size
        name = np.add.reduceat(mixed(rep.view(np.uint64) * np.uint64(2) + probe), cut) + size.astype(np.uint64)
        name, first = np.unique(name, return_index=True)
        at = ragged(cut[first], size[first])
        return pa.RecordBatch.from_pydict({"meeting": np.repeat(mixed(name), size[first]).view(np.int64), "rep": rep[at], "probe": probe[at]})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            of = batch.column(0).to_numpy()
            for k in range(batch.num_rows):
                if of[k] != bucket:
                    if parts and (out := meet_one(parts)) is not None:
                        yield out
                    bucket, parts = of[k], []
                names, packed = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((1, "<i8"), (2, "<u8")))
                # Copied: the batch is given back before the bucket is complete.
                parts.append((packed.copy(), names[(packed >> np.uint64(2)).astype(np.int64) & 0x3FFF]))
        if parts and (out := meet_one(parts)) is not None:
            yield out

    dealt = docs.mapInArrow(to_keys, "bucket int, names binary, keys binary")
    sorted_ = dealt.repartition(tasks(spark), "bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(meet, "meeting long, rep long, probe boolean")


_LINKED = "100 * shared >= 75 * (nu + nv - shared)"


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, nu, nv, shared): sizes and intersection of the sets of every pair."""
    left = sets.select(F.col("rep").alias("u"), F.col("grams").alias("gu"))
    right = sets.select(F.col("rep").alias("v"), F.col("grams").alias("gv"))
    both = pairs.join(left, "u").join(right, "v")
    return both.select("u", "v", F.size("gu").alias("nu"), F.size("gv").alias("nv"), F.size(F.array_intersect("gu", "gv")).alias("shared"))


def _homes(tested: DataFrame) -> DataFrame:
    """(rep, home, i): of the sets a set was tested against, the one most were, and how
    much it shares with it.  Sets never tested against another are their own home."""
    often = tested.groupBy("u").agg(F.count("*").alias("often"))
    best = F.max(F.struct("often", (-F.col("u")).alias("least"), "shared")).alias("b")
    return tested.join(often, "u").groupBy(F.col("v").alias("rep")).agg(best).select("rep", (-F.col("b.least")).alias("home"), F.col("b.shared").alias("i"))


# What two sets must share beyond their home's n-grams to be linked, at least.
_NEED = "ceil(3 * (nu + nv) / 7) - least(iu, iv)"


def _sides(df: DataFrame, key: str, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*key.split(), F.col("rep").alias(r), *(F.col(c).alias(c + r) for c in columns)) for r in "uv")


def _direct(placed: DataFrame) -> DataFrame:
    """(u, v) of different components that meet, unless their shared home shows that they
    can only be linked by n-grams it lacks."""
    one, two = _sides(placed, "meeting", ("probe", "n", "s", "c", "home", "i"))
    apart = F.expr(f"u < v AND cu <> cv AND (probeu OR probev) AND (homeu <> homev OR {_NEED} <= 0)")
    return one.join(two, "meeting").where(apart & _possible("nu", "su", "nv", "sv")).select("u", "v").distinct()


def _through_rest(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) with one home, of different components, that share enough n-grams which
    the home lacks.

    One of the two is not in the home's component.  Of the n-grams such a set has beyond
    its home and in common with anyone there, it needs some number; so it shares one of
    the rarest, whatever that number leaves.
    """
    docs = placed.select("rep", "n", "c", "home", "i").distinct()
    main = docs.select(F.col("rep").alias("home"), F.col("c").alias("main")).distinct()
    docs = docs.where("rep <> home").join(main, "home", "left").withColumn("left", F.expr("main IS NULL OR c <> main"))
    family = docs.groupBy("home").agg(F.min("n").alias("small"), F.max("left").alias("any")).where("any").drop("any")
    docs = docs.join(family, "home").join(sets.select("rep", "grams"), "rep")
    docs = docs.join(sets.select(F.col("rep").alias("home"), F.col("grams").alias("base")), "home")
    rest = docs.select("home", "rep", "n", "c", "i", "left", "small", F.explode(F.array_except("grams", "base")).alias("gram"))
    rest = kept(rest, "rest")
    common = rest.groupBy("home", "gram").agg(F.count("*").alias("df")).where("df > 1")
    rest = kept(rest.join(common, ["home", "gram"]), "rest")
    needed = F.greatest(F.lit(1), F.ceil(3 * (F.col("n") + F.greatest(F.col("small"), F.ceil(0.75 * F.col("n")))) / 7) - F.col("i"))
    held = rest.where("left").groupBy("rep").agg(F.count("*").alias("have"))
    rare = F.row_number().over(Window.partitionBy("rep").orderBy("df", "gram"))
    looks = rest.where("left").join(held, "rep").withColumn("place", rare).where(F.col("place") <= F.col("have") - needed + 1)
    one = looks.select("home", "gram", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    two = rest.select("home", "gram", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    sized = (F.col("a") != F.col("b")) & (F.col("ca") != F.col("cb")) & (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
    return one.join(two, ["home", "gram"]).where(sized).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _possible(n1: str, s1: str, n2: str, s2: str) -> Column:
    """Whether sets of these sizes, that share no more than these parts with any other
    set, can be linked: the intersection is at least 3/7 of the two sizes together."""
    n1, s1, n2, s2 = map(F.col, (n1, s1, n2, s2))
    return (7 * F.least(s1, s2) >= 3 * (n1 + n2)) & (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key) of rows with an id; the key tells texts of one id apart."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return own.where("doc_id IS NOT NULL")


def _linked(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(node, component) of the sets that are linked with another one."""
    common = _common(docs, named.count())
    met = kept(_meetings(docs, common).groupBy("meeting", "rep").agg(F.max("probe").alias("probe")), "meetings")
    # One text for every set that meets another.
    firsts = named.where("n_shingles > 0").groupBy("rep").agg(F.min(F.struct("doc_id", "text_key")).alias("f"))
    firsts = firsts.join(met.select("rep").distinct(), "rep", "left_semi").select("f.doc_id", "f.text_key")

    def to_sets(batch: pa.RecordBatch) -> dict:
        found = [(grams, sizes, _set_id(grams, sizes)) for _, _, grams, sizes in _set_blocks(batch.column(1))]
        grams, sizes, rep = (np.concatenate(c) for c in zip(*found))
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return {"rep": rep, "grams": pa.ListArray.from_arrays(ends, pa.array(grams.view(np.int64)))}

    chosen = docs.join(firsts, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    sets = kept(mapped(chosen.select("doc_id", "text"), to_sets, "rep long, grams array<long>"), "sets")
    # N-grams that no other set has cannot be shared, which bounds every similarity.
    owned = sets.select("rep", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    owned = owned.where("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
    bounds = sets.select("rep", F.size("grams").alias("n")).join(owned, "rep", "left")
    bounds = bounds.select("rep", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("s")).where("4 * s >= 3 * n")
    met = kept(met.join(bounds, "rep"), "meetings")

    # First every set of a meeting against the one with the largest shared part.
    best = F.max(F.struct("probe", (F.col("s") / F.col("n")).alias("share"), (-F.col("rep")).alias("least"), "n", "s")).alias("b")
    head = met.groupBy("meeting").agg(best).where("b.probe").select("meeting", (-F.col("b.least")).alias("u"), F.col("b.n").alias("nu"), F.col("b.s").alias("su"))
    star = met.join(head, "meeting").where((F.col("rep") != F.col("u")) & _possible("n", "s", "nu", "su"))
    tested = kept(_shared(star.select("u", F.col("rep").alias("v")).distinct(), sets), "tested")
    links = tested.where(_LINKED).select("u", "v")
    found = components(links)

    # Then what else meets across components.
    label = F.coalesce("component", "rep").alias("c")
    placed = met.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*met.columns, label)
    split = placed.groupBy("meeting").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("meeting")
    placed = placed.join(split, "meeting", "left_semi").join(_homes(tested), "rep", "left")
    placed = kept(placed.withColumn("home", F.coalesce("home", "rep")).withColumn("i", F.coalesce("i", "n")), "placed")
    pairs = _direct(placed).union(_through_rest(placed, sets)).distinct()
    pairs = pairs.join(tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    more = kept(_shared(pairs, sets).where(_LINKED).select("u", "v"), "links")
    return found if more.isEmpty() else _joined(found, more)


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links (u, v)."""
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links))


def _labelled(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` (with ``rep``) and the component of each as ``label``."""
    return sets.join(found.withColumnsRenamed({"node": "rep", "component": "label"}), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents.

    The component is the smallest doc_id reachable by links, the row's own included.
    Null and empty texts and texts without words have no shingles and no links; repeated
    rows, ties and equal texts share a component.  Rows of one doc_id with different texts
    have a row and a size each, and what is linked with any of the texts is reachable
    from that id.  Rows without doc_id are left out; other columns are not read.
    """
    docs = _keyed(docs)
    named = kept(_named(docs), "named")
    found = _linked(docs, named)
    # Texts of one id belong together.
    owners = named.where("n_shingles > 0")
    several = owners.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("w")).where("u <> w").select("doc_id", "u")
    if not several.isEmpty():
        found = _joined(found, owners.join(several, "doc_id").where("rep <> u").select("u", F.col("rep").alias("v")))
    sets = kept(_labelled(named.where("n_shingles > 0").groupBy("rep").agg(F.min("doc_id").alias("least")), found), "labels")
    least = sets.groupBy("label").agg(F.min("least").alias("component_id"))
    of = sets.join(least, "label").select("rep", "component_id")
    out = named.join(of, "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay when one row of each group of near copies stays: that of
    the least doc_id, and among texts of that id the one of least hash.

    Of repeated rows the one of least hash over all columns stays.  Rows of one doc_id
    whose texts are no near copies all stay, and so do rows without words and rows
    without id, which are linked with nothing.
    """
    keyed = _keyed(docs)
    named = kept(_named(keyed), "named")
    some = named.where("n_shingles > 0").groupBy("rep").agg(F.min(F.struct("doc_id", "text_key")).alias("f"))
    stay = _labelled(some, _linked(keyed, named)).groupBy("label").agg(F.min("f").alias("f")).select("f.*")
    bare = named.where("n_shingles = 0").select("doc_id", "text_key").distinct()
    marks = kept(stay.withColumn("worded", F.lit(True)).unionByName(bare.withColumn("worded", F.lit(False))), "stay")
    marks = marks.select(F.col("doc_id").alias("_gf_id"), F.col("text_key").alias("_gf_text"), F.col("worded").alias("_gf_worded"))
    names = [f"`{c}`" for c in docs.columns]
    same = (docs["doc_id"].cast("long") == marks["_gf_id"]) & (F.xxhash64(docs["text"]) == marks["_gf_text"])
    rows = docs.join(marks, same)
    one = F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_gf_row")
    once = rows.where("_gf_worded").groupBy("_gf_id", "_gf_text").agg(one).select("_gf_row.*")
    return once.unionAll(rows.where("NOT _gf_worded").select(*names)).unionAll(docs.where("doc_id IS NULL"))
