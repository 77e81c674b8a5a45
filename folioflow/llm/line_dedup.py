"""Line dedup by a log-template tree.

Lines that stand verbatim in several documents recur. Beyond that, lines are generalised by
a tree of fixed depth: the number of tokens, the leading tokens, then the templates of that
node. Tokens that hold a digit are variable fields, and a template has wildcards for some
of a line's eight runs of tokens besides: two for lines of eight tokens or more, one for
shorter ones. Whatever varies, at least half of a template's tokens and no fewer than
``LEAST`` are constant, and no more than a third of them are fields alone; rows of figures,
of which less would be left, are only ever compared verbatim. A line matches every template that it equals but for what varies, and since lines
that differ may differ in meaning, a template recurs only from many documents on. What
matches and what recurs depends on the lines alone, not on their order or place.

A copy of a whole text is no recurrence of its lines. Equal texts are one document, and
a text whose five-word shingles are for 0.8 or more those of the first text that holds
most of its lines is of one class with it. Classes count, and templates that recur
across classes are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import linking
from folioflow.llm.common import Scratch, bounded_batches, table, text_or_empty
from folioflow.llm.jaccard_join import shingles

#: Blanks of a line besides the space, in ASCII and beyond.
BLANKS, WIDE_BLANKS = "\t\x0b\x0c\r", "\xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u3000"
RUNS = 8
#: Wildcards of a template of lines of ``RUNS`` tokens or more, and of shorter ones.
VARIABLE, SHORT_VARIABLE = 2, 1
LEADING = 2
#: Constant tokens of a template, at least; half of its tokens are constant besides.
LEAST = 4
FIELD = "<*>"
#: Texts that one task compares with the first text of a class, on average.
PART = 2000


def spaced(text: Column) -> Column:
    """The text with spaces for other blanks of a line. Each is sought by itself, which costs less than a regular expression of all."""
    has = lambda blanks: reduce(or_, (text.contains(c) for c in blanks))
    some = has(BLANKS) | ((F.octet_length(text) > F.length(text)) & has(WIDE_BLANKS))
    return F.when(some, F.regexp_replace(text, f"[{BLANKS}{WIDE_BLANKS}]", " ")).otherwise(text)


def masked(line: Column) -> Column:
    """The line with a mark in place of every token that holds a digit; null if there is none."""
    return F.when(line.rlike(r"\d"), F.regexp_replace(line, r"(?<![^ ])[^ \d]*+\d[^ ]*", FIELD))


def tight(line: Column) -> Column:
    """The line's tokens with one space between them."""
    return F.when(line.contains("  "), F.trim(F.regexp_replace(line, "  +", " "))).otherwise(F.trim(line))


def n_fields(line: Column) -> Column:
    """How many tokens of a tight line are marks."""
    apart = F.concat(F.lit(" "), F.replace(line, F.lit(" "), F.lit("  ")), F.lit(" "))
    return ((F.octet_length(apart) - F.octet_length(F.replace(apart, F.lit(f" {FIELD} "), F.lit("")))) / (len(FIELD) + 2)).cast("int")


def with_runs(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with the eight runs of tokens of about equal length as run0 to run7, cut in halves; ``n`` is how many tokens the tight line has."""
    bound = lambda k: (F.col("n") * k / RUNS).cast("int")
    names, step = [line], RUNS
    while step > 1:
        halves, step = {}, step // 2
        for k, name in enumerate(names):
            low, mid, high = (bound(j * step) for j in (2 * k, 2 * k + 1, 2 * k + 2))
            for part, tokens in ((2 * k, mid - low), (2 * k + 1, mid - high)):  # the last ones, where the number is negative
                halves[f"run{part}of{step}"] = F.call_function("substring_index", F.col(name), F.lit(" "), tokens)
        lines, names = lines.withColumns(halves), list(halves)
    return lines.withColumnsRenamed({name: f"run{k}" for k, name in enumerate(names)})


def lanes(half: int) -> Column:
    """Four of the eight runs, as 16 bits of hash each in a long."""
    out = F.lit(0).cast("long")
    for k in range(RUNS // 2):
        lane = F.hash(f"run{half * (RUNS // 2) + k}").bitwiseAND(0xFFFF).cast("long")
        out = out.bitwiseOR(F.shiftleft(lane, 16 * k))
    return out


def wildcards(variable: int) -> list[Column]:
    """A key for each choice of so many runs as wildcards."""
    keys = []
    for k, left_out in enumerate(combinations(range(RUNS), variable)):
        halves = [sum(0xFFFF << 16 * (r % (RUNS // 2)) for r in range(RUNS) if r // (RUNS // 2) == half and r not in left_out) for half in (0, 1)]
        low, high = (F.col(c).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")) for c, mask in zip(("low", "high"), halves, strict=True))
        keys.append(F.xxhash64(F.lit(100 * variable + k), "n", "lead", low, high))
    return keys


def templates(lines: DataFrame, everywhere: int) -> DataFrame:
    """(item, template, wild) for rows of distinct lines (item, n, free, mask, lead, low, high, low_doc, high_doc, rows).

    ``mask`` names the line's fields, if it has any and enough besides; ``free`` lines may have wildcards. Lines of a template
    agree in the runs that are no wildcards. Of four pairs of runs, or two halves for short lines, such lines agree in one that
    is known beforehand, so that lines that meet no other there have no need of keys. ``wild`` is false for a line by itself,
    which stands in several documents. Templates of one document are left out, and wild ones of fewer than ``everywhere`` lines.
    """
    scratch = Scratch(lines.sparkSession, "templates")
    pairs = [F.shiftrightunsigned("low", 32), F.col("high").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("high", 32)]
    long_nodes, short_nodes = (F.array(*(F.xxhash64(F.lit(k), "n", "lead", x) for k, x in enumerate(parts))) for parts in (pairs, ["low", "high"]))
    some = lines.where("free")
    nodes = some.select("item", F.explode(F.when(F.col("n") >= RUNS, long_nodes).otherwise(short_nodes)).alias("node"))
    shared = scratch.put(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("node"), "shared")
    meeting = scratch.put(nodes.join(shared.hint("merge"), "node", "left_semi").select("item").distinct(), "meeting")
    keys = F.when(F.col("n") >= RUNS, F.array(*wildcards(VARIABLE))).otherwise(F.array(*wildcards(SHORT_VARIABLE)))
    keyed = some.join(meeting.hint("merge"), "item", "left_semi").select("item", "low_doc", "high_doc", "rows", F.explode(keys).alias("template"))
    keyed = scratch.put(keyed.unionByName(lines.where("mask is not null").select("item", "low_doc", "high_doc", "rows", F.col("mask").alias("template"))), "keyed")
    held = keyed.groupBy("template").agg(
        F.count(F.lit(1)).alias("lines"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"), F.min("low_doc").alias("low_doc"), F.max("high_doc").alias("high_doc"), F.sum("rows").alias("rows")
    )
    # Templates of the same lines are one.
    held = held.where((F.col("lines") > 1) & (F.col("low_doc") < F.col("high_doc")) & (F.col("rows") >= everywhere)).groupBy("lines", "x", "y").agg(F.min("template").alias("template"))
    held = scratch.put(held.select("template"), "held")
    wild = keyed.select("item", "template").join(held.hint("merge"), "template", "left_semi").withColumn("wild", F.lit(True))
    alone = lines.where("low_doc < high_doc").select("item", F.xxhash64(F.lit(-1), "item").alias("template"), F.lit(False).alias("wild"))
    return wild.unionByName(alone)


def copies(docs: DataFrame, held: DataFrame, tokens: DataFrame, text_col: str, share: float, similarity: float) -> DataFrame:
    """(doc, class) for texts that are near copies of an earlier one: ``class`` is the first of them.

    Each text with ``share`` of its tokens in lines that one earlier text holds first is compared with that text, the one
    with most of them, by their exact sets of shingles. ``held`` has (template, doc, id, at, n), a doc is the MD5 of its text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "copies")
    first = held.groupBy("template").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "doc")).alias("first"))
    first = scratch.put(first.select("template", F.col("first.doc").alias("up")), "first")
    by = held.select("template", "doc", "at", "n").distinct().join(first, "template").where("doc <> up").select("doc", "up", "at", "n").distinct()
    by = by.groupBy("doc", "up").agg(F.sum("n").alias("shared")).groupBy("doc").agg(F.max(F.struct("shared", "up")).alias("most"))
    near = by.join(tokens, "doc").where(F.col("most.shared") >= share * F.col("tokens")).select("doc", F.col("most.up").alias("up"))
    near = scratch.put(near, "near")
    # A hot first text is dealt out with a part of those to compare it with.
    parts = scratch.put(near.groupBy("up").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "parts")
    later = near.join(parts, "up").select("doc", "up", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"))
    firsts = parts.select(F.col("up").alias("doc"), "up", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    wanted = scratch.put(later.unionByName(firsts), "wanted")
    text = text_or_empty(docs[text_col])
    # Their number grows with the documents, so that no size of the input has them broadcast.
    texts = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("doc"), text.alias("text")).join(wanted.select("doc").distinct().hint("merge"), "doc", "left_semi")
    texts = scratch.put(texts.dropDuplicates(["doc"]), "texts")
    rows = wanted.join(texts, "doc").select("up", "part", "side", "doc", "text").repartition(linking.tasks_of(docs), "up", "part").sortWithinPartitions("up", "part", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        against = np.empty(0, np.uint64)
        for b in batches:
            out: list = [[], []]
            for up, side, doc, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                found = shingles(text)
                if side == 0:
                    against = found
                else:
                    both = len(np.intersect1d(found, against, assume_unique=True))
                    if both >= similarity * (len(found) + len(against) - both) - 1e-9:
                        out[0].append(doc)
                        out[1].append(up)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], names=["doc", "up"])

    found, k = scratch.put(rows.mapInArrow(compare, "doc binary, up binary"), "found"), 0
    while True:  # each leads to an earlier one; a round doubles the steps
        k += 1
        nxt = found.select(F.col("doc").alias("up"), F.col("up").alias("top"))
        new = scratch.put(found.join(nxt, "up", "left").select("doc", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), f"found-{k}")
        moved = new.agg(F.max("moved")).first()[0]
        found = new.drop("moved")
        if not moved:
            return found.withColumnRenamed("up", "class")


def decide(
    docs: DataFrame, min_docs: int = 2, everywhere: int = 10, min_tokens: int = 4, copy_share: float = 0.2, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, dropped) for texts that lose lines, by the MD5 of the text: dropped holds the places of these lines, from 0."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "line-dedup")
    text = text_or_empty(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("doc"), spaced(text).alias("text"))
    # The lines are rows before anything is done to them: Spark compiles no function of an array's elements.
    rows = rows.select("id", "doc", F.posexplode(F.split("text", "\n")).alias("at", "line")).where("trim(line) <> ''")
    rows = rows.withColumn("line", tight(F.col("line"))).withColumn("masked", masked(F.col("line"))).withColumn("said", F.coalesce("masked", "line"))
    rows = rows.withColumn("n", F.octet_length("said") - F.octet_length(F.replace("said", F.lit(" "), F.lit(""))) + 1)
    rows = rows.withColumn("constant", F.when(F.col("masked").isNull(), F.col("n")).otherwise(F.col("n") - n_fields(F.col("masked"))))
    # What wildcards can take besides the fields: two runs, or a single token of a short line.
    most = F.when(F.col("n") >= RUNS, VARIABLE * F.ceil(F.col("n") / RUNS)).otherwise(SHORT_VARIABLE)
    enough = lambda left: (left >= LEAST) & (2 * left >= F.col("n"))
    rows = rows.withColumn("free", enough(F.col("constant") - most)).withColumn("cut", F.when(F.col("free"), F.col("said")))
    rows = with_runs(rows, "cut")
    rows = scratch.put(
        rows.select(
            "id", "doc", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "n", "free", F.hash(F.substring_index("said", " ", LEADING)).alias("lead"),
            F.when((F.col("constant") < F.col("n")) & enough(F.col("constant")) & (3 * F.col("constant") >= 2 * F.col("n")), F.xxhash64(F.lit(-2), "masked")).alias("mask"),
            F.when(F.col("free"), lanes(0)).alias("low"), F.when(F.col("free"), lanes(1)).alias("high"),
        ),
        "lines",
    )
    holder = F.xxhash64("doc")
    distinct = rows.groupBy("h1", "h2").agg(
        *(F.min(c).alias(c) for c in ("n", "free", "mask", "lead", "low", "high")), F.min(holder).alias("low_doc"), F.max(holder).alias("high_doc"), F.count(F.lit(1)).alias("rows")
    )
    distinct = scratch.put(distinct.withColumn("item", F.monotonically_increasing_id()), "distinct")
    named = scratch.put(templates(distinct, everywhere).join(distinct.select("item", "h1", "h2"), "item").drop("item"), "named")
    # Lines that no other document has go no further.
    lined = rows.select("id", "doc", "at", "n", "h1", "h2").join(named.select("h1", "h2").distinct().hint("merge"), ["h1", "h2"], "left_semi")
    lined = scratch.put(lined, "lined")
    held = scratch.put(lined.join(named.hint("merge"), ["h1", "h2"]).select("template", "doc", "id", "at", "n"), "held")
    lengths = rows.select("doc", "at", "n").join(lined.select("doc").distinct().hint("merge"), "doc", "left_semi").groupBy("doc", "at").agg(F.min("n").alias("n"))
    lengths = scratch.put(lengths.groupBy("doc").agg(F.sum("n").alias("tokens")), "lengths")
    classes = copies(docs, held, lengths, text_col, copy_share, similarity)
    known = lined.join(classes, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    known = scratch.put(known.select("h1", "h2", "class", "doc", "id", "at", "n"), "known")
    # A line meets its templates once a class, and a document's line once what they say of the line.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("class").alias("class")))
    each_class = known.groupBy("h1", "h2", "class").agg(F.max("n").alias("n"), first.alias("first")).join(named.hint("merge"), ["h1", "h2"])
    each_class = each_class.groupBy("template", "class").agg(F.max("n").alias("n"), F.max("wild").alias("wild"), F.min("first").alias("first"))
    spread = each_class.groupBy("template").agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("n"), F.max("wild").alias("wild"), F.min("first").alias("first"))
    enough = F.when((F.col("n") >= min_tokens) & ~F.col("wild"), F.lit(min_docs)).otherwise(F.lit(everywhere))
    recurring = spread.where(F.col("classes") >= enough).select("template", F.col("first.class").alias("first_class"), (F.col("classes") >= everywhere).alias("all_of_them"))
    recurring = scratch.put(recurring, "recurring")
    said = named.join(recurring.hint("merge"), "template").groupBy("h1", "h2").agg(F.max("all_of_them").alias("all_of_them"), F.min("first_class").alias("low"), F.max("first_class").alias("high"))
    # Some template has another first class if one end of them is another.
    gone = known.join(said.hint("merge"), ["h1", "h2"]).where(F.col("all_of_them") | (F.col("class") != F.col("low")) | (F.col("class") != F.col("high")))
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with recurring lines dropped from the text; adds n_lines (before) and n_dropped.

    * A line recurs when ``min_docs`` classes of documents hold it verbatim, but for blanks. It is kept in the first of them, by
      id, or in none once ``everywhere`` classes hold it. Lines of fewer tokens than ``min_tokens``, and lines that only share
      a template, recur from ``everywhere`` classes on.
    * Equal texts are of one class, and near copies (``similarity``) of an earlier text that holds ``copy_share`` of the tokens.
    * A null text counts as empty; blank lines are never dropped by themselves; a line repeated in one document only stays.
    * Repeated rows (same id and text) are copies of each other and stay repeated. Null ids come last. An empty table gives no rows.
    * Long texts count whole, and so do long lines. Other columns stay; columns named n_lines or n_dropped are replaced.
    """
    gone = decide(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias("doc"), "dropped")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = text_or_empty(docs[text_col])
    whole = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), F.unhex(F.md5(text.cast("binary"))).alias("doc"))
    # What loses lines grows with the documents, so that no size of the input has it broadcast.
    found = whole.join(gone.hint("merge"), "doc", "left")
    lines = F.split(text_or_empty(F.col(f"row.`{text_col}`")), "\n")  # the row's own text: it moves once
    left = F.filter(lines, lambda x, at: ~F.array_contains(F.col("dropped"), at))
    cleaned = F.when(F.col("dropped").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(left, "\n"))
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0))
    return found.select(*(cleaned.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names), F.size(lines).alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(n_dropped).alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")
