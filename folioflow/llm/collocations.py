"""Phrase collocations from position bitmaps of words, as SPAM extends sequences.

Texts are cut into shards: up to ``SHARD`` words of one language, in which a boundary takes
the place between two pieces. In a shard every word has the bitmap of its positions,
compressed as roaring bitmaps are: 64 positions a number where the word is frequent, the
sorted positions where it is rare. A phrase's bitmap, shifted by one and intersected with a
word's, is the bitmap of the phrase with that word behind it, and its popcount the phrase's
count in the shard; a boundary is in no bitmap, so that no phrase crosses one. Rare bitmaps
are disjoint and are intersected all at once, by asking which word stands at a position.

Phrases are extended depth-first, some first words at a time. Popcounts are summed over the
shards and a phrase goes on only if its sum reaches the least count: one round per length,
in which shards go down to that length along what has proved frequent, and sums go back to
the shards that hold the phrase. Words and phrases are numbers then, and a phrase is
exactly the number of its beginning and that of its last word; nothing is hashed away.
Counts of a shard travel as packed arrays, dealt by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, bounded_batches, table, text_or_empty
from folioflow.llm.linking import tasks_of

#: Words of a shard (a longer document is one by itself), and positions that are extended at a time.
SHARD, BATCH = 1 << 19, 1 << 18
#: A word that has this share of a shard's positions is kept as bits.
DENSE = 1 / 64
#: Parts of a language whose best phrases are found by themselves before they meet.
PARTS = 32
UNDETERMINED = "und"
#: A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
BOUNDARY, NOTHING = -1, -2


class _Numbers(dict):
    """Words by the order in which they come."""

    def __init__(self) -> None:
        super().__init__({b"": NOTHING, b"\n": BOUNDARY})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 2
        return n


def pack(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed byte by byte of their differences."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel())


def cut(docs: DataFrame, text_col: str, lang_col: str, size: int) -> DataFrame:
    """(shard, lang, word, local, n, tokens): the words of each shard with their counts, and one row without a word that has its tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        open_: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            numbers, parts = open_.pop(lang)
            del sizes[lang]
            tokens = np.concatenate(parts)
            tokens = tokens[tokens != NOTHING]
            tokens = tokens[(tokens != BOUNDARY) | (np.roll(tokens, 1) != BOUNDARY)]
            words = len(numbers) - 2
            if not words:
                return
            counts = np.bincount(tokens[tokens >= 0], minlength=words)
            blob = pa.compress(tokens.tobytes(), codec="zstd", asbytes=True)
            # Words come in the order of their numbers, after the two marks.
            columns = [
                pa.array(np.full(words + 1, first + made)),
                pa.array([lang] * (words + 1)),
                pa.array([None, *(w.decode() for w in list(numbers)[2:])], pa.string()),
                pa.array(np.arange(-1, words, dtype=np.int32)),
                pa.array(np.concatenate([[len(tokens)], counts]).astype(np.int64)),
                pa.array([blob] + [None] * words, pa.binary()),
            ]
            made += 1
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "word", "local", "n", "tokens"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = text.encode().translate(PIECES).replace(b"\n", b" \n ").split(b" ")
                if lang in open_ and sizes[lang] and sizes[lang] + len(tokens) > size:
                    yield from closed(lang)
                numbers, parts = open_.setdefault(lang, (_Numbers(), []))
                parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                parts.append(np.array([BOUNDARY], np.int32))
                sizes[lang] = sizes.get(lang, 0) + len(tokens)
                if sum(sizes.values()) > 2 * size:
                    yield from closed(max(sizes, key=sizes.get))
        for lang in sorted(open_):
            yield from closed(lang)

    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(UNDETERMINED)).alias("lang"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(work, "shard long, lang string, word string, local int, n long, tokens binary")


class Bitmaps:
    """The bitmaps of a shard's frequent words, as bits or as sorted positions. ``words`` has the number of the word at each position, or -1."""

    def __init__(self, words: np.ndarray, width: int, dense: float = DENSE):
        self.words = np.append(words, -1)  # what stands behind the last position
        self.order = np.argsort(words, kind="stable")
        self.order = self.order[np.count_nonzero(words < 0) :]
        self.counts = np.bincount(words[words >= 0], minlength=width)
        self.ends = np.cumsum(self.counts)
        self.dense = np.flatnonzero(self.counts > max(64, dense * len(words)))
        self.bits = {int(w): self.as_bits(self.positions(w)) for w in self.dense}
        rare = np.ones(width, bool)
        rare[self.dense] = False
        self.rare = rare
        self.rare_at = np.flatnonzero((words >= 0) & rare[words])

    def positions(self, word: int) -> np.ndarray:
        return self.order[self.ends[word] - self.counts[word] : self.ends[word]]

    def as_bits(self, positions: np.ndarray) -> np.ndarray:
        flags = np.zeros(-(-(len(self.words) + 1) // 64) * 64, np.uint8)
        flags[positions] = 1
        return np.packbits(flags, bitorder="little").view(np.uint64)

    @staticmethod
    def shifted(bits: np.ndarray) -> np.ndarray:
        out = bits << np.uint64(1)
        out[1:] |= bits[:-1] >> np.uint64(63)
        return out

    def after_dense(self, word: int, counts_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Followers of a frequent word, their popcounts, and unless only these are wanted the positions of all, follower by follower."""
        moved = self.shifted(self.bits[word])
        followers, counts, at = [], [], []
        for w in self.dense.tolist():
            both = moved & self.bits[w]
            n = int(np.bitwise_count(both).sum())
            if n:
                followers.append(w)
                counts.append(n)
                if not counts_only:
                    at.append(np.flatnonzero(np.unpackbits(both.view(np.uint8), bitorder="little")))
        met = self.rare_at[(moved[self.rare_at >> 6] >> (self.rare_at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
        w, n = np.unique(self.words[met], return_counts=True)
        if not counts_only:
            at.append(met[np.argsort(self.words[met], kind="stable")])
        none = np.zeros(0, np.int64)
        return np.concatenate([np.array(followers, np.int64), w]), np.concatenate([np.array(counts, np.int64), n]), np.concatenate(at or [none])

    def batches(self, most: int) -> Iterator[np.ndarray]:
        """Rare words in turn, whose bitmaps have so many positions in all, as their positions in the order of the words."""
        words = np.flatnonzero(self.rare & (self.counts > 0))
        total = np.cumsum(self.counts[words])
        for part in np.split(words, np.flatnonzero(np.diff(total // most)) + 1) if len(words) else []:
            yield np.concatenate([self.positions(w) for w in part.tolist()])


def phrase_counts(bitmaps: Bitmaps, names: np.ndarray, width: int, known: list[tuple[np.ndarray, np.ndarray]], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Keys and popcounts of the phrases of len(known) + 2 words whose beginnings are known to be frequent.

    A key is the number of the phrase without its last word, shifted by ``width`` bits, and the name of the last word. ``known``
    has for two words, three and so on the sorted keys of frequent phrases and their numbers.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def go_on(level: int, keys: np.ndarray, counts: np.ndarray, at: Callable[[], np.ndarray]) -> None:
        """Keys of ``level`` words with popcounts, and their positions, key by key."""
        if level == len(known) + 2:
            out.append((keys, counts))
            return
        have, numbers = known[level - 2]
        place = np.minimum(np.searchsorted(have, keys), max(0, len(have) - 1))
        fine = have[place] == keys if len(have) else np.zeros(len(keys), bool)
        if fine.any():
            extend(level, np.repeat(numbers[place[fine]], counts[fine]), at()[np.repeat(fine, counts)])

    def extend(level: int, owner: np.ndarray, positions: np.ndarray) -> None:
        """``owner`` is the number of the phrase that ends at each position."""
        moved = positions + 1
        follower = bitmaps.words[moved]
        some = follower >= 0
        keys = (owner[some] << width) | names[follower[some]]
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            go_on(level + 1, keys[first], np.diff(np.append(first, len(keys))), lambda: moved[some][order])

    for word in bitmaps.dense.tolist():
        followers, counts, at = bitmaps.after_dense(word, not known)
        if len(followers):
            go_on(2, (names[word] << width) | names[followers], counts, lambda at=at: at)
    for positions in bitmaps.batches(batch):
        extend(1, names[bitmaps.words[positions]], positions)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out])


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard, from batches that are sorted by shard."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        shards = b.column(0).to_numpy()
        first = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for start, end in zip(first, first[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != shards[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def counted(rows: DataFrame, length: int, width: int, buckets: int, tasks: int) -> DataFrame:
    """(bucket, shard, n, keys, counts): the popcounts of the phrases of ``length`` words in every shard, dealt by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in by_shard(batches):
            kind = shard.column("kind").to_numpy()
            pick = lambda k: shard.filter(pa.array(kind == k))  # noqa: E731, B023
            text, named = pick(0), pick(1)
            if not named.num_rows:
                continue
            n = text.column("n")[0].as_py()
            tokens = np.frombuffer(pa.decompress(text.column("a")[0].as_py(), 4 * n, codec="zstd", asbytes=True), np.int32)
            look_up = np.full(int(tokens.max()) + 2, -1, np.int32)
            look_up[named.column("local").to_numpy()] = np.arange(named.num_rows, dtype=np.int32)
            names = named.column("id").to_numpy()
            known = []
            for k in range(2, length):
                sent = pick(k)
                parts = [[unpack(x, m) for x, m in zip(sent.column(c).to_pylist(), sent.column("n").to_pylist(), strict=True)] for c in ("a", "b")]
                keys, numbers = (np.concatenate([np.zeros(0, np.int64), *p]) for p in parts)
                order = np.argsort(keys)
                known.append((keys[order], numbers[order]))
            keys, counts = phrase_counts(Bitmaps(look_up[tokens], len(names)), names, width, known)
            if not len(keys):
                continue
            bucket = ((keys * np.int64(-0x61C8864680B583EB)).view(np.uint64) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.lexsort((keys, bucket))
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(first[1:], len(keys))
            columns = [
                pa.array(bucket[first].astype(np.int32)),
                pa.array(np.full(len(first), shard.column("shard")[0].as_py())),
                pa.array((ends - first).astype(np.int32)),
                *(pa.array([pack(x[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in (keys, counts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "shard", "n", "a", "b"])

    rows = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "kind")
    return rows.mapInArrow(work, "bucket int, shard long, n int, a binary, b binary")


def summed(counts: DataFrame, buckets: int, least: int, width: int, back: bool) -> DataFrame:
    """Phrases whose sums reach ``least``: rows (prefix, word, f, id); and with ``back`` rows (shard, n, keys, ids) for the shards that hold them."""
    names = ["shard", "n", "a", "b", "prefix", "word", "f", "id"]

    def one(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, sizes = rows.column("bucket")[0].as_py(), rows.column("n").to_numpy()
        keys, counts = (np.concatenate([unpack(x, n) for x, n in zip(rows.column(c).to_pylist(), sizes.tolist(), strict=True)]) for c in ("a", "b"))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums = np.add.reduceat(counts[order], first)
        fine = sums >= least
        found, f = keys[first][fine], sums[fine]
        ids = bucket + buckets * np.arange(len(found), dtype=np.int64)
        none = lambda n, kind: pa.nulls(n, kind)
        n = len(found)
        yield pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.int32()), none(n, pa.binary()), none(n, pa.binary()), pa.array(found >> width), pa.array(found & ((1 << width) - 1)), pa.array(f), pa.array(ids)], names=names)
        if not (back and n):
            return
        numbers = np.full(len(first), -1, np.int64)
        numbers[fine] = ids
        numbers = np.repeat(numbers, np.diff(np.append(first, len(keys))))
        shard = np.repeat(rows.column("shard").to_numpy(), sizes)[order]
        shard, keys, numbers = shard[numbers >= 0], keys[numbers >= 0], numbers[numbers >= 0]
        order = np.lexsort((keys, shard))
        shard, keys, numbers = shard[order], keys[order], numbers[order]
        start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        ends = np.append(start[1:], len(shard))
        n = len(start)
        blobs = [pa.array([pack(x[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in (keys, numbers)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[start]), pa.array((ends - start).astype(np.int32)), *blobs, *(none(n, pa.int64()) for _ in range(4))], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        buckets_here = rows.column("bucket").to_numpy()
        for bucket in np.unique(buckets_here).tolist():
            yield from one(rows.filter(pa.array(buckets_here == bucket)))

    return counts.repartitionById(buckets, "bucket").mapInArrow(work, "shard long, n int, a binary, b binary, prefix long, word long, f long, id long")


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of phrases of 1 to ``longest`` words that stand ``least`` times, and (lang, n), the words of each language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "collocations")
    buckets = tasks_of(docs)
    shards = scratch.put(cut(docs, text_col, lang_col, shard), "shards")
    words = shards.where("word is not null")
    sizes = scratch.put(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    # A partition and a row's place in it make a small number of it.
    place = F.monotonically_increasing_id()
    frequent = frequent.withColumn("place", place).withColumn("id", F.col("place").bitwiseAND((1 << 33) - 1) * buckets + F.shiftright("place", 33)).drop("place")
    frequent = scratch.put(frequent, "words")
    last, apart = frequent.agg(F.max("id"), F.countDistinct("id") == F.count("id")).first()
    if last is None:
        return frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f"), sizes
    if not apart:
        raise RuntimeError("more partitions than spark.sql.shuffle.partitions: numbers of words are not unique")
    width = max(1, int(last).bit_length())
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("a", "b")]
    texts = shards.where("word is null").select("shard", F.lit(0).alias("kind"), F.lit(-1).alias("local"), F.lit(-1).cast("long").alias("id"), F.col("n").cast("int").alias("n"), F.col("tokens").alias("a"), nothing[1])
    named = words.select("shard", "lang", "word", "local").join(frequent.select("lang", "word", "id"), ["lang", "word"])
    named = scratch.put(named.select("shard", F.lit(1).alias("kind"), "local", "id", F.lit(0).alias("n"), *nothing), "named")
    rows = texts.unionByName(named)
    level = frequent.select("id", "lang", F.col("word").alias("phrase"), "f")
    every = [level.select("lang", "phrase", F.lit(1).alias("size"), "f")]
    for length in range(2, longest + 1):
        found = summed(counted(rows, length, width, buckets, buckets), buckets, least, width, back=length < longest)
        found = scratch.put(found, f"found-{length}")
        last_word = frequent.select(F.col("id").alias("word"), F.col("word").alias("spelled"))
        level = found.where("id is not null").select("prefix", "word", "f", F.col("id").alias("number")).join(level.select(F.col("id").alias("prefix"), "lang", "phrase"), "prefix")
        level = level.join(last_word, "word").select(F.col("number").alias("id"), "lang", F.concat_ws(" ", "phrase", "spelled").alias("phrase"), "f")
        level = scratch.put(level, f"phrases-{length}")
        every.append(level.select("lang", "phrase", F.lit(length).alias("size"), "f"))
        most = level.agg(F.max("id")).first()[0]
        if most is None:
            break
        if length < longest and int(most).bit_length() + width > 63:
            raise OverflowError("too many frequent phrases for keys of 63 bits")
        sent = found.where("shard is not null").select("shard", F.lit(length).alias("kind"), F.lit(-1).alias("local"), F.lit(-1).cast("long").alias("id"), "n", "a", "b")
        rows = rows.unionByName(sent)
    phrases = every[0]
    for more in every[1:]:
        phrases = phrases.unionByName(more)
    phrases = scratch.put(phrases, "phrases")
    for name in ("shards", "named", *(f"found-{k}" for k in range(2, longest + 1))):
        scratch.drop(name)
    return phrases, sizes


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, inside: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of every language: lang, rank, phrase, a, l, r, n, score.

    * Texts are lower-cased in A-Z, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at spaces and tabs. A null text is
      empty; a null language is ``und`` and one with rows that say so.
    * ``a`` counts a phrase that stands ``least`` times. Of its cuts into two, with counts ``l`` and ``r``, the one with the least
      floor(2000000 a / (l + r)) scores, and the first of equal ones.
    * A phrase inside a longer one that has ``inside`` percent of its count or more is left out, whether or not the longer one is.
    * Repeated rows count each; whole texts count, and a word or piece may be of any length. An empty table gives no rows.
    * Other columns, whatever their names, are not read.
    """
    phrases, sizes = frequent_phrases(docs, longest, least, text_col, lang_col, shard)
    scratch = Scratch(docs.sparkSession, "collocation-scores")
    words = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    piece = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = words.select("lang", "phrase", "size", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    counts = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div cast(cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)) as decimal(20, 0))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    size = F.col("size")
    starts = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    within = words.where(size > 2).select("lang", "f", F.explode(F.array_distinct(starts)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * inside))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = free.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = scratch.put(best.select("lang", "phrase", "a", "l", "r", "score"), "best")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from t),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as words from p),
sizes as (select lang, cast(sum(len(words)) as bigint) as n from w group by all),
grams as (
  select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from w, range(1, 5) r(k) where len(words) >= k) x),
f as (select lang, k, phrase, cast(count(*) as bigint) as f from grams group by all having count(*) >= 30),
c as (select lang, k, phrase, string_split(phrase, ' ') as words, f as a from f where k > 1),
cuts as (select lang, k, phrase, words, a, unnest(range(1, k)) as j from c),
scored as (
  select cuts.lang, cuts.phrase, a, x.f as l, y.f as r, cast((2000000::hugeint * a) // (x.f + y.f) as bigint) as score, j
  from cuts join f x on x.lang = cuts.lang and x.phrase = array_to_string(words[1:j], ' ') join f y on y.lang = cuts.lang and y.phrase = array_to_string(words[j + 1:], ' ')
  qualify row_number() over (partition by cuts.lang, cuts.phrase order by score, j) = 1),
subs as (select lang, a, k, words, m, unnest(range(1, k - m + 2)) as s from c, range(2, 4) r(m) where m < k),
inner_ as (select lang, array_to_string(words[s:s + m - 1], ' ') as phrase, max(a) as longer from subs group by all),
free as (select s.* from scored s left join inner_ i on i.lang = s.lang and i.phrase = s.phrase where longer is null or 100::hugeint * longer < 80::hugeint * a)
select free.lang, row_number() over w as rank, phrase, a, l, r, n, score from free join sizes on sizes.lang = free.lang
window w as (partition by free.lang order by score desc, a desc, phrase) qualify row_number() over w <= 2000
"""
